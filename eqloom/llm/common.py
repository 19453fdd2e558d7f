"""Shared plumbing: durable intermediate tables, word and hash arrays, crc folds."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES, SIEVE_BITS, HOT_KEYS = 1 << 20, 27, 10_000
MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor sees.

    Where the cluster names none (tests, a laptop) a folder under /tmp is used;
    that default is for local mode alone.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints"


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/eqloom/{tag}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    It cuts the lineage: a lost executor costs the tasks it was running, and no
    later stage computes the table again.  The table is deleted when the driver ends, if not before.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote, once whatever needed them has been written itself."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores added until no column is called so."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def sieve(keys: DataFrame, bits: int = SIEVE_BITS) -> DataFrame:
    """(b, w0..w7): a bitmap of 2 ** bits bits in rows of eight words, with a bit for each long in column key.

    Its size is bounded by `bits` (2 ** (bits - 9) rows), whatever the number of keys; a null key sets no bit.
    """
    n = keys.where("key is not null").select(F.pmod("key", F.lit(1 << bits)).alias("n")).distinct()
    word = F.shiftright("n", 6).bitwiseAND(F.lit(7))
    return n.groupBy(F.shiftright("n", 9).alias("b")).agg(*[F.coalesce(F.bit_or(F.when(word == j, _bit(F.col("n")))), F.lit(0).cast("long")).alias(f"w{j}") for j in range(8)])


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.bitwiseAND(F.lit(63)).cast("int"))


def bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """A bit for the low bits of each long in column key: 2 ** bits bits on the driver, whatever the number of keys."""
    n = F.pmod("key", F.lit(1 << bits)) + 1
    out = np.zeros(max(1, (1 << bits) // 32768) * 4096, np.uint8)
    for r in keys.where("key is not null").select(n.alias("n")).groupBy(F.bitmap_bucket_number("n").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("m")).collect():
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["m"], np.uint8)
    return out


def sifted(rows: DataFrame, key: Column, keys: DataFrame, as_name: str, bits: int = SIEVE_BITS) -> DataFrame:
    """rows with a boolean column: false where the key is surely none of `keys` (see sieve).

    The bitmap is broadcast (262,144 rows of 72 bytes at most), so no row moves.  A chance hit only
    sends a row the longer way.
    """
    b, k, *words = unused([*rows.columns, as_name], "_b", "_k", *[f"_w{j}" for j in range(8)])
    word = F.element_at(F.array(*words), (F.shiftright(k, 6).bitwiseAND(F.lit(7)) + 1).cast("int"))
    hit = F.coalesce(word.bitwiseAND(_bit(F.col(k))) != 0, F.lit(False))
    found = rows.withColumn(k, F.pmod(key, F.lit(1 << bits))).withColumn(b, F.shiftright(k, 9))
    held = keys.select(F.col("b").alias(b), *[F.col(f"w{j}").alias(w) for j, w in enumerate(words)])
    return found.join(F.broadcast(held), b, "left").withColumn(as_name, hit).drop(b, k, *words)


def on_few(rows: DataFrame, key: Column, few: DataFrame, few_key: Column, then, otherwise) -> DataFrame:
    """then(rows whose key may be one of few's) and otherwise(the rest), which moves nowhere.

    For joins of whole texts with a table that names some of them: only those are shuffled.
    """
    (hit,) = unused(rows.columns, "_hit")
    both = sifted(rows, key, sieve(few.select(few_key.alias("key"))), hit)
    return then(both.where(hit).drop(hit)).unionByName(otherwise(both.where(~F.col(hit)).drop(hit)))


def join_counted(rows: DataFrame, counted: DataFrame, on: list[str], n: str = "n", hot: int = HOT_KEYS) -> DataFrame:
    """Inner join of rows with a table of their keys and the number of rows of each (column n).

    Keys with at least 1/hot of all those rows are at most `hot`, which bounds the broadcast
    that joins their rows where they are; the other keys are shuffled, each with a small share.
    """
    total = counted.agg(F.sum(n)).first()[0] or 0
    least = F.lit(total / hot)
    often = F.broadcast(counted.where(F.col(n) >= least))
    rest = rows.join(often.select(*on), on, "left_anti").join(counted.where(F.col(n) < least), on)
    return rows.join(often, on).unionByName(rest)


def crc_fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds (null for a null id)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % F.lit(folds)


def unit_hash(*cols: str, seed: int = 11) -> Column:
    """A fixed pseudo-random number in [0, 1) for a row."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in cols]), F.lit(1 << 20)) / F.lit(float(1 << 20))


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each; a longer text is a range of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo, base = 0, 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield lo, hi
        base, lo = int(size[hi - 1]), hi
    give_back()


def give_back() -> None:
    """Return freed memory to the system, so idle workers of an executor hold little."""
    state = kept_state()
    if "trim" not in state:
        import ctypes

        try:
            state["trim"] = ctypes.CDLL("libc.so.6").malloc_trim
        except (OSError, AttributeError):
            state["trim"] = int
    pa.default_memory_pool().release_unused()
    state["trim"](0)


def tidy(run):
    """run over batches; what it held last goes back to the system, so a worker that waits for its next task holds little."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def plain(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One chunk of strings with 64-bit offsets, nulls as empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        col = col if isinstance(col, pa.Array) else pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    return pc.fill_null(col.cast(pa.large_string()), "")


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Maximal runs of [^\\x20\\x09-\\x0D]: offsets of each text (n + 1) and the flat words."""
    lists = pc.ascii_split_whitespace(texts)
    flat, lens = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(lens)])
    full = pc.greater(pc.binary_length(flat), 0)
    mask = full.to_numpy(zero_copy_only=False)
    if not mask.all():
        flat = flat.filter(full)
        offsets = np.concatenate([[0], np.cumsum(mask)])[offsets]
    return offsets, flat


def dictionary(words: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    enc = words.dictionary_encode()
    return enc.indices.to_numpy(zero_copy_only=False), enc.dictionary.cast(pa.large_binary()).to_pylist()


def word_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word."""
    from xxhash import xxh3_64_intdigest as h

    idx, uniq = dictionary(words)
    return np.fromiter((h(u, seed) for u in uniq), np.uint64, len(uniq))[idx] if len(uniq) else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes (len(h) - k + 1 of them), order-sensitive."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc = (acc ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    return mix(acc)


def kept_state() -> dict:
    """Objects a Python worker keeps between tasks (tokenizers, word caches)."""
    return sys.__dict__.setdefault("_eqloom_state", {})


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))
