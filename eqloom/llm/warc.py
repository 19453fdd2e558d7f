"""WARC archives: a PySpark Python data source that writes and reads them.

    df.write.format("eqloom_warc").mode("append").save(path)
    spark.read.format("eqloom_warc").load(path)

A path needs its scheme here, as workers know no default file system; archive and read add it.

Writing: each task writes archives of its own name; the commit lists the files of the
successful attempts, with marks at record boundaries, in a manifest.  What a lost or
repeated attempt left is in no manifest and is never read.

Reading: the driver plans one partition for each range between marks (or each file, where
there is no manifest).  A reader parses the header block of each record first; record-type
and header predicates that Spark pushes down are checked on it, and the payload of a record
that fails them, or that nobody asked for (option payload=false), is passed over by seeking
without being decoded.  gzip archives of other writers are read member by member.
"""

from __future__ import annotations

import base64
import gzip
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from eqloom.llm.common import discard, join_counted, materialize, sieve, sifted

SCHEMA = "row_id long, record_type string, record_id string, target_uri string, warc_date string, payload_digest string, refers_to long, payload_bytes long, payload binary"
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date", "row_id": "x-row-id", "refers_to": "x-refers-to-row"}
LEAST, SPLIT, ROTATE = 1000, 32 << 20, 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme: one without means the file system that Spark itself would take."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def record_id(row: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{row}/{digest}')}>"


def _line(s: str) -> str:
    return " ".join(s.split("\n")).replace("\r", " ")


def to_record(row: int | None, url: str | None, digest: str, size: int, refers_to: int | None, payload: bytes) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {record_id(row, digest)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {_line(url)}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    head += [f"X-Row-Id: {row}"] if row is not None else []
    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Row: {refers_to}"] if refers_to is not None else []
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_headers(f) -> dict[str, str] | None:
    """The header block at the file's place, names lowered; None at the end."""
    line = f.readline()
    while line in (b"\r\n", b"\n"):
        line = f.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record: {line[:40]!r}")
    out: dict[str, str] = {}
    while (line := f.readline()).strip():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int | None


@dataclass
class Written(WriterCommitMessage):
    files: list  # (name, size, marks)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        done, out, name, size, marks = [], None, "", 0, [0]
        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    name, size, marks = f"part-{uuid.uuid4().hex}.warc", 0, [0]
                    out = fs.open_output_stream(f"{root}/{name}")
                rec = to_record(r["row_id"], r["target_uri"], r["payload_digest"], r["payload_bytes"], r["refers_to"], r["payload"] or b"")
                if size - marks[-1] >= SPLIT:
                    marks.append(size)
                out.write(rec)
                size += len(rec)
                if size >= ROTATE:
                    out.close()
                    done.append((name, size, marks))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size, marks))
        return Written(done)

    def commit(self, messages: list) -> None:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([x for m in messages if m is not None for x in m.files]).encode())

    def abort(self, messages: list) -> None:
        fs, root = _fs(self.path)
        for m in messages:
            for name, _, _ in m.files if m is not None else ():
                fs.delete_file(f"{root}/{name}")


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.want = options["path"], options.get("payload", "true").lower() == "true"
        self.tests: list = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in HEADERS and isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith, StringEndsWith, StringContains)):
                self.tests.append((HEADERS[name], name in ("row_id", "refers_to"), type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Range]:
        from pyarrow import fs as pfs

        fs, root = _fs(self.path)
        names = [i.path for i in fs.get_file_info(pfs.FileSelector(root)) if i.type == pfs.FileType.File] if fs.get_file_info(root).type == pfs.FileType.Directory else [root]
        lists = [n for n in names if n.rpartition("/")[2].startswith("_manifest-")]
        if not lists:
            return [Range(n, 0, None) for n in sorted(names) if n.endswith((".warc", ".warc.gz"))]
        out = []
        for n in sorted(lists):
            with fs.open_input_stream(n) as f:
                for name, size, marks in json.loads(f.read()):
                    out += [Range(f"{root}/{name}", a, z) for a, z in zip(marks, [*marks[1:], size])]
        return out

    def _passes(self, h: dict) -> bool:
        for key, num, kind, value in self.tests:
            v = h.get(key)
            if v is None:
                return False
            v = int(v) if num else v
            ok = {"EqualTo": lambda: v == value, "In": lambda: v in value, "IsNotNull": lambda: True, "StringStartsWith": lambda: v.startswith(value), "StringEndsWith": lambda: v.endswith(value), "StringContains": lambda: value in v}[kind]()
            if not ok:
                return False
        return True

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # Spark's single partition where none was planned
            return
        fs, _ = _fs(self.path)
        if part.path.endswith(".gz"):
            f = io.BufferedReader(gzip.GzipFile(fileobj=fs.open_input_file(part.path)))
        else:
            f = io.BufferedReader(fs.open_input_file(part.path), 1 << 18)
            f.seek(part.start)
        schema = pa.schema([("row_id", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        rows, held = [], 0
        while part.end is None or f.tell() < part.end:
            h = read_headers(f)
            if h is None:
                break
            size = int(h["content-length"])
            after = f.tell() + size
            if self._passes(h):
                n, payload = size, None
                if h.get("content-type", "").startswith("application/http"):
                    n = 0
                    while (line := f.readline()).strip():
                        k, _, v = line.partition(b":")
                        n = int(v) if k.strip().lower() == b"content-length" else n
                if self.want and h.get("warc-type") == "response":
                    payload = f.read(after - f.tell())
                    n = len(payload)
                digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
                rows.append({"row_id": int(h["x-row-id"]) if "x-row-id" in h else None, "record_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "target_uri": h.get("warc-target-uri"), "warc_date": h.get("warc-date"), "payload_digest": base64.b32decode(digest).hex() if len(digest) == 32 else digest or None, "refers_to": int(h["x-refers-to-row"]) if "x-refers-to-row" in h else None, "payload_bytes": n, "payload": payload})
                held += len(payload or b"") + 500
            f.seek(after)
            if held >= 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "eqloom_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> None:
    """Write a record for each row: payloads of at least `least` bytes once, then as revisits.

    Of rows with equal payloads the one with the largest id is the response (each of them,
    if rows repeat that id).  A null payload is empty, one of any length is one record; a null url has no target header; a row
    with a null id is written without a row id, and is a revisit if another row has its payload.
    Other columns are not read, whatever they are called.  An empty table makes an archive without records.

    Payloads are written where they are read.  A bitmap of fixed size says whether a payload may
    be repeated, a second one whether the row needs its payload all the same (as the response, or
    because the first bitmap was wrong): only rows with a repeated payload are joined with the
    responses' ids, and those that are surely revisits go without their payload.
    """
    spark = pages.sparkSession
    register(spark)
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    src = pages.select(F.col(id_col).cast("long").alias("row_id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload"))
    src = src.withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.length("payload").cast("long")})
    heads = src.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("row_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1 and head is not null")
    heads = materialize(heads, "heads")
    same, own = F.xxhash64("payload_digest"), lambda row: F.xxhash64("payload_digest", row)
    repeated = materialize(sieve(heads.select(same.alias("key"))), "repeated")
    wrong = sifted(src.drop("payload"), same, repeated, "again").where("again").join(heads, "payload_digest", "left_anti")
    needed = materialize(sieve(heads.select(own("head").alias("key")).unionByName(wrong.select(own("row_id").alias("key")))), "needed")
    src = sifted(src, same, repeated, "again")
    none = F.lit(None).cast("long").alias("refers_to")
    parts = ["row_id", "target_uri", "payload_digest", "payload_bytes", none, "payload"]
    once = src.where("not again").select(*parts)
    again = sifted(src.where("again"), own("row_id"), needed, "full").withColumn("payload", F.when(F.col("full"), F.col("payload")))
    lone = again.where("full").join(heads, "payload_digest", "left_anti").select(*parts)
    refers = F.when(~F.col("row_id").eqNullSafe(F.col("head")), F.col("head"))
    known = join_counted(again, heads, ["payload_digest"]).withColumn("refers_to", refers).withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    once.unionByName(lone).unionByName(known.select(*once.columns)).write.format("eqloom_warc").mode("append").save(qualified(spark, path))
    discard(heads, repeated, needed)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of an archive or a folder of archives; payload=False reads headers only."""
    register(spark)
    return spark.read.format("eqloom_warc").option("payload", str(payload).lower()).load(qualified(spark, path))
