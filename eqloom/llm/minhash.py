"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

1. One Python pass per document: the distinct k-word shingles, a 128-bit fingerprint of
   the set, and a fast similarity sketch.  Rounds of hashed bin placement fill t
   coordinates: in round i < t every shingle falls into one hashed bin, in rounds t..2t-1
   into bin i - t, and a bin keeps its least (round, value).  A set is left as soon as all
   its bins are full, so a long text needs two or three rounds and every coordinate is
   filled after at most 2t.
2. Sets with equal fingerprints become one class (map-side combine: a copy group of any
   size is one row), and classes are banded.
3. Each bucket's least class is compared with the other members, exactly, on full sets,
   and links are joined to components.
4. Buckets that still hold two components are compared in full, in blocks of bounded size:
   a task gets two blocks, counts all intersections by matrix product over the shingles
   that occur at least twice, and returns a spanning forest of the true links.  No pair is
   emitted, no partner is capped, no bucket is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eqloom.llm.common import as_long, discard, materialize, mix, ngram_hashes, plain, split_words, text_slices, tidy, word_hashes
from eqloom.llm.components import connected_components

BANDS, ROWS, BLOCK, SHINGLES = 30, 5, 512, 2_000_000
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each (already lower-cased) text."""
    off, words = split_words(texts)
    h = word_hashes(words)
    out = []
    for a, b in zip(off[:-1], off[1:]):
        w = h[a:b]
        out.append(np.unique(ngram_hashes(w, k)) if b - a >= k else ngram_hashes(np.concatenate([w, [np.uint64(b - a)]]), b - a + 1) if b > a else w)
    return out


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketch: one row of t coordinates a set; sets must not be empty."""
    n = len(sets)
    bins = np.full(n * t, FULL)
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    x = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    for i in range(2 * t):
        r = mix(x + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        at = (r >> np.uint64(32)) % np.uint64(t) if i < t else np.full(len(x), i - t, np.uint64)
        val = (np.uint64(i) << np.uint64(32)) | (r & np.uint64(0xFFFFFFFF))
        np.minimum.at(bins, doc * t + at.astype(np.int64), val)
        open_ = (bins.reshape(n, t) == FULL).any(axis=1)
        if not open_.any():
            break
        if not open_[doc].all():
            keep = open_[doc]
            doc, x = doc[keep], x[keep]
    return bins.reshape(n, t)


def band_keys(sk: np.ndarray, bands: int, rows: int) -> np.ndarray:
    acc = np.zeros((len(sk), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        acc = mix((acc ^ sk[:, : bands * rows].reshape(-1, bands, rows)[:, :, j]) * np.uint64(0x9E3779B97F4A7C15))
    return acc


def _sketch_pass(k: int, bands: int, rows: int):
    from hashlib import blake2b

    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            texts = pc.ascii_lower(plain(b.column("text")))
            ids = b.column("id")
            for lo, hi in text_slices(texts):
                part = texts.slice(lo, hi - lo)
                sets = shingle_sets(part, k)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = band_keys(sketches([sets[i] for i in full], bands * rows), bands, rows)
                fp = np.frombuffer(b"".join(blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
                width = np.zeros(len(sets), np.int64)
                width[full] = bands
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width)]), pa.int32()), as_long(keys.ravel()))
                z = [pack.compress(v.as_py().encode()) if len(s) else None for v, s in zip(part, sets)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp[:, 0]), pa.array(fp[:, 1]), lists, pa.array(z, pa.binary())],
                    ["id", "n", "fp1", "fp2", "bands", "z"],
                )

    return tidy(run)


def _linked(inter: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (na + nb - inter)


def _sets_of(zs: list[bytes], k: int) -> list[np.ndarray]:
    import zstandard

    un = zstandard.ZstdDecompressor()
    return shingle_sets(pa.array([un.decompress(z).decode() for z in zs], pa.large_string()), k)


def _verify_pairs(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                za, zb = part.column("za").to_pylist(), part.column("zb").to_pylist()
                place = {z: i for i, z in enumerate(dict.fromkeys([*za, *zb]))}
                sets = _sets_of(list(place), k)
                ok = []
                for x, y in zip(za, zb):
                    s, t = sets[place[x]], sets[place[y]]
                    i = len(np.intersect1d(s, t, assume_unique=True))
                    ok.append(bool(100 * i >= percent * (len(s) + len(t) - i)))
                yield pa.RecordBatch.from_arrays([part.column("a").filter(pa.array(ok)), part.column("b").filter(pa.array(ok))], ["a", "b"])

    return run


def intersections(sets: list[np.ndarray], chunk: int = 8192) -> np.ndarray:
    """All intersection sizes of a bounded block, by matrix product over shared elements."""
    n = len(sets)
    x, doc = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    _, inv, count = np.unique(x, return_inverse=True, return_counts=True)
    shared = count > 1
    col = np.cumsum(shared) - 1
    keep = shared[inv]
    doc, col = doc[keep], col[inv[keep]]
    order = np.argsort(col, kind="stable")
    doc, col = doc[order], col[order]
    out = np.zeros((n, n), np.float32)
    for lo in range(0, int(shared.sum()), chunk):
        a, b = np.searchsorted(col, [lo, lo + chunk])
        m = np.zeros((n, chunk), np.float32)
        m[doc[a:b], col[a:b] - lo] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _verify_block(k: int, percent: int):
    def run(t: pa.Table) -> pa.Table:
        node, seen = [], {}
        for i, (x, z) in enumerate(zip(t.column("node").to_pylist(), t.column("z").to_pylist())):
            if (x, z) not in seen:
                seen[x, z] = i
                node.append(x)
        sets = _sets_of([z for _, z in seen], k)
        n = np.array([len(s) for s in sets])
        i, j = np.nonzero(np.triu(_linked(intersections(sets), n[:, None], n[None, :], percent), 1))
        up = list(range(len(node)))

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        a, b = [], []
        for x, y in zip(i.tolist(), j.tolist()):
            p, q = root(x), root(y)
            if p != q:
                up[p] = q
                a.append(node[x])
                b.append(node[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 85, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row.

    Two rows are linked if 100 * |A & B| >= percent * |A | B| on their sets of k-word
    shingles of the text with A-Z lowered.  Null, empty and blank texts have n_shingles 0
    and stay alone.  The id is taken for a key: rows that repeat an id with one text are one
    document; if an id comes with several texts, each row gets the component of its own
    text, and texts whose least id is that id are one node.  A null id is linked with nothing: component_id null, kept true.  Other columns are not read, so
    their names don't matter.  An empty table gives an empty table.

    At a similarity of 0.85 a pair shares no band with probability 2e-8, at 0.8 with 7e-6.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sk = materialize(src.mapInArrow(_sketch_pass(k, bands, rows), "id long, n long, fp1 long, fp2 long, bands array<long>, z binary"), "fss")
    live = sk.where("n > 0 and id is not null")
    by = ["fp1", "fp2", "n"]
    classes = materialize(live.groupBy(*by).agg(F.min("id").alias("node")), "classes")
    # the row that gives a class its name also gives its bands
    named = live.select("id", *by, "bands").join(classes, by).where("id = node").select("node", *by, "bands").dropDuplicates(["node", *by])
    member = materialize(named.select("node", "n", F.explode("bands").alias("bucket")), "bands")
    head = member.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("head"), F.count(F.lit(1)).alias("m")).where("m > 1")
    near = F.expr(f"100 * least(n, head.n) >= {percent} * greatest(n, head.n)")
    stars = member.join(head, "bucket").where(F.col("node") != F.col("head.node")).where(near).select(F.col("head.node").alias("a"), F.col("node").alias("b")).distinct()
    stars = materialize(stars, "stars")
    text_a, text_b = live.select(F.col("id").alias("a"), F.col("z").alias("za")), live.select(F.col("id").alias("b"), F.col("z").alias("zb"))
    links = stars.join(text_b, "b").join(text_a, "a").mapInArrow(_verify_pairs(k, percent), "a long, b long")
    comp1 = materialize(connected_components(links, "a", "b"), "comp1")

    # buckets that still hold several components
    placed = member.join(comp1, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("c"))
    placed = materialize(placed.join(head.select("bucket"), "bucket"), "placed")
    open_ = (
        placed.groupBy("bucket")
        .agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"), F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x2"))
        .where("c1 <> c2")
        .groupBy("m", "w", "x1", "x2")
        .agg(F.min("bucket").alias("bucket"))
    )
    # a block holds `block` texts, or fewer if they are long
    parts = F.ceil(F.greatest(F.col("m") / F.lit(block), F.col("w") / F.lit(SHINGLES))).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(7)), parts).cast("int")
    rows_ = placed.join(open_.select("bucket", "m", "w"), "bucket").select("bucket", "node", mine.alias("p"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("q"))
    rows_ = rows_.select("bucket", "node", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"))
    rows_ = rows_.join(live.select(F.col("id").alias("node"), "z"), "node")
    found = rows_.groupBy("bucket", "i", "j").applyInArrow(_verify_block(k, percent), "a long, b long")
    c_of = lambda side: comp1.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    more = found.join(c_of("a"), "a", "left").join(c_of("b"), "b", "left").select(F.coalesce("ca", "a").alias("u"), F.coalesce("cb", "b").alias("v"))
    comp2 = connected_components(more)
    final = (
        classes.join(comp1, "node", "left")
        .select(*by, F.coalesce("component", "node").alias("c"))
        .join(comp2.select(F.col("node").alias("c"), F.col("component").alias("c2")), "c", "left")
        .select(*by, F.coalesce("c2", "c").alias("component_id"))
    )
    discard(member, stars, placed)
    out = sk.select("id", *by).join(final, by, "left")
    comp_id = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp_id.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
