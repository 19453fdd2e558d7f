"""Nearest neighbours by query-aware collision counting.

Inner products become distances on the unit sphere (one more coordinate fills each vector
up to the largest norm).  Every vector is projected on m random lines; each block of vectors
keeps one sorted array a line.  A query opens a window round its own projection on each line
and widens all of them together (virtual rehashing: the windows of a radius contain those
of the radii before), by whole eighths of the sorted array, so that the collisions of many
queries are counted by one matrix product.  A vector met in at least `share` of the windows is verified by its
true inner product, and the widening ends when enough vectors of the block have been
verified (`beta` of them; with 1.0 all are, and the answer is exact).  Vectors and queries meet in a grid of blocks of bounded size; each cell gives its
best k, and a ranking over cells gives the answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eqloom.llm.common import materialize

LINES, SHARE, BETA, BINS, BLOCK, QUERY_BLOCK = 64, 0.6, 0.3, 8, 8192, 8192


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products added from left to right, so equal vectors tie exactly."""
    s = np.zeros(len(x))
    for d in range(x.shape[1]):
        s += x[:, d] * q[d]
    return s


def search_block(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, qs: np.ndarray, k: int, top: float, lines: int = LINES, share: float = SHARE, beta: float = BETA, bins: int = BINS, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best found of one block for each query: query ids, vector ids, scores."""
    n, dim = x.shape
    a = np.random.default_rng(seed).standard_normal((dim + 1, lines))
    fill = np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1) / (top * top)))
    p = np.hstack([x / top, fill[:, None]]) @ a
    lined = np.sort(p, axis=0)
    steps = lined[np.arange(1, bins) * n // bins]  # windows widen by whole steps of the sorted arrays
    place = np.column_stack([np.searchsorted(steps[:, j], p[:, j], side="right") for j in range(lines)])
    held = np.zeros((n, lines * bins), np.float32)
    held[np.arange(n)[:, None], np.arange(lines) * bins + place] = 1
    pq = (qs / np.linalg.norm(qs, axis=1, keepdims=True)) @ a[:dim]
    need, want = int(np.ceil(share * lines)), min(n, max(8 * k, int(beta * n)))
    out: list[list] = [[], [], []]

    def verify(i: int, hit: np.ndarray) -> None:
        at = np.nonzero(hit & (ids != qids[i]))[0]
        # the matrix product ranks; the places that may be among the k get their exact product
        s = x[at] @ qs[i]
        if len(at) > k:
            at = at[s >= np.partition(s, len(s) - k)[len(s) - k] - 1e-9 * top * np.abs(qs[i]).sum()]
        s = inner(x[at], qs[i])
        best = np.lexsort((ids[at], -s))[:k]
        for col, v in zip(out, (np.full(len(best), qids[i]), ids[at][best], s[best])):
            col.append(v)

    for lo in range(0, len(qs), 128):
        left, radius = np.arange(lo, min(lo + 128, len(qs))), 1.0
        while len(left):
            ends = [np.stack([np.searchsorted(steps[:, j], pq[left, j] + s * radius, side="right") for j in range(lines)], 1) for s in (-1, 1)]
            window = (np.arange(bins) >= ends[0][:, :, None]) & (np.arange(bins) <= ends[1][:, :, None])
            met = window.reshape(len(left), -1).astype(np.float32) @ held.T >= need
            enough = (met.sum(axis=1) >= want) | window.all(axis=(1, 2))
            for r in np.nonzero(enough)[0]:
                verify(left[r], met[r])
            left, radius = left[~enough], radius * 1.3
    return tuple(np.concatenate(c) if c else np.zeros(0) for c in out)


def _cell(k: int, top: float, **how):
    def run(t: pa.Table) -> pa.Table:
        isq = t.column("is_query").to_numpy()
        ids = t.column("id").to_numpy()
        v = t.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        o = np.argsort(ids, kind="stable")
        ids, v, isq = ids[o], v[o], isq[o]
        q, i, s = search_block(ids[~isq], v[~isq], ids[isq], v[isq], k, top, **how) if (~isq).any() and isq.any() else ([], [], [])
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())})

    return run


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK, **how) -> DataFrame:
    """(query_id, rank, vec_id, score) of each row for which is_query holds, against all rows but itself.

    The measure is the inner product in double precision; ties go to the smaller id.  Rows
    with a null id, a null, empty or zero vector, or a null, NaN or infinite component take
    no part; nor do vectors of another length than the commonest.  Repeated rows of an id
    count once, with the smallest vector.  Other columns are not read.  No rows give no rows.

    The copies of the vectors, one for each block of `query_block` queries, are what moves.
    """
    v = F.col(vec_col).cast("array<double>")
    src = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    src = src.where(F.col("id").isNotNull() & F.coalesce(sound, F.lit(False)))
    src = src.groupBy("id").agg(F.min("v").alias("v")).withColumn("q", is_query(F.col("id")))
    src = materialize(src, "vectors")
    dims = src.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, vec_id long, score double"
    if dims is None:
        return src.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    src = src.where(F.size("v") == dims["d"])
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n, nq, top = src.agg(F.count(F.lit(1)), F.count_if("q"), F.sqrt(F.max(norm2))).first()
    nb, qb = max(1, -(-n // block)), max(1, -(-nq // query_block))
    grid = lambda df, own, parts, other, others: df.withColumn(own, F.pmod(F.xxhash64("id", F.lit(3)), F.lit(parts)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
    data = grid(src, "b", nb, "g", qb).select("b", "g", "id", "v", F.lit(False).alias("is_query"))
    asks = grid(src.where("q"), "g", qb, "b", nb).select("b", "g", "id", "v", F.lit(True).alias("is_query"))
    found = data.unionByName(asks).groupBy("b", "g").applyInArrow(_cell(k, top, **how), schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
