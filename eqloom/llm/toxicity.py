"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the hashed 1-, 2- and 3-grams of its words (lower-cased, outer
punctuation removed) and its skip-grams (a word and the next but one), each present or
absent.  Training streams a bounded sample of labelled rows through FTRL-proximal: every
coordinate has its own learning rate and an L1 threshold, so all but a few hundred weights
stay zero; those travel with the scoring function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eqloom.llm.common import dictionary, mix, ngram_hashes, plain, split_words, text_slices, tidy, unit_hash

BITS, PER_CLASS, EPOCHS = 20, 2500, 6
EDGE = b".,;:!?\"'()[]{}<>|*#%&$-_~`"


def _hashes(words: pa.Array) -> np.ndarray:
    from xxhash import xxh3_64_intdigest as h

    idx, uniq = dictionary(words)
    low = pc.utf8_lower(pa.array(uniq, pa.binary()).cast(pa.string())).to_pylist()
    return np.fromiter((h(u.encode().strip(EDGE), 3) for u in low), np.uint64, len(low))[idx] if len(low) else np.zeros(0, np.uint64)


def features(h: np.ndarray, bits: int) -> list[tuple[int, np.ndarray]]:
    """(words spanned, coordinate of the feature that starts at each word) by feature kind."""
    mask = np.uint64((1 << bits) - 1)
    skip = mix((h[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[2:] + np.uint64(77))) if len(h) > 2 else h[:0]
    return [(1, (mix(h) & mask).astype(np.int64)), (2, (ngram_hashes(h, 2) & mask).astype(np.int64)), (3, (ngram_hashes(h, 3) & mask).astype(np.int64)), (3, (skip & mask).astype(np.int64))]


@dataclass
class Weights:
    bits: int
    at: np.ndarray  # coordinates that are not zero
    w: np.ndarray
    bias: float


def _rows(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = plain(b.column("text"))
            for lo, hi in text_slices(texts):
                off, words = split_words(texts.slice(lo, hi - lo))
                h = _hashes(words)
                xs = [np.unique(np.concatenate([x for _, x in features(h[a:z], bits)])).astype("<u4").tobytes() for a, z in zip(off[:-1], off[1:])]
                yield pa.RecordBatch.from_arrays([b.column("id").slice(lo, hi - lo), b.column("y").slice(lo, hi - lo), pa.array(xs, pa.binary())], ["id", "y", "x"])

    return run


def ftrl(rows: list[tuple[int, np.ndarray]], bits: int, epochs: int = EPOCHS, alpha: float = 1.0, beta: float = 1.0, l1: float = 10.0, l2: float = 1.0, weight: float = 3.0) -> tuple[np.ndarray, float]:
    """Weights and bias after streaming (label, coordinates) rows several times.

    A row of label 1 counts `weight` times: missing one costs more than a false alarm.
    """
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    order = np.random.default_rng(1)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            y, x = rows[r]
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((beta + np.sqrt(nx)) / alpha + l2))
            wb = -zb / ((beta + np.sqrt(nb)) / alpha)
            g = (1 / (1 + np.exp(-np.clip(w.sum() + wb, -35, 35))) - y) * (weight if y else 1.0)
            z[x] = zx + g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / alpha * w
            n[x] = nx + g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * wb
            nb += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return w, float(-zb / ((beta + np.sqrt(nb)) / alpha))


def class_sample(labelled: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """About per_class rows of each label y (never more than twice that) and each label's share."""
    count = {r["y"]: r["count"] for r in labelled.groupBy("y").count().collect()}
    share = {y: min(1.0, per_class / n) for y, n in count.items()}
    if not share:
        return labelled, share
    picked = F.create_map(*[x for y, s in share.items() for x in (F.lit(y), F.lit(s))])
    return labelled.where(unit_hash("id") < F.try_element_at(picked, F.col("y"))).limit(2 * per_class * len(share)), share


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, bits: int = BITS, **how) -> Weights:
    """Fit on about per_class labelled rows of each class; null labels are left out, and of several labels of an id the largest holds.

    A row is at most 2 ** bits coordinates, so `per_class` bounds what reaches the driver in bytes as well.
    The labels are sampled before the texts are joined to them.
    """
    y = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    y, share = class_sample(y, per_class)
    if len(share) < 2:
        return Weights(bits, np.zeros(0, np.int64), np.zeros(0), 5.0 if 1 in share else -5.0)
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(y), "id")
    got = text.mapInArrow(_rows(bits), "id long, y int, x binary").collect()
    got.sort(key=lambda r: (r["id"], r["x"]))
    w, bias = ftrl([(r["y"], np.frombuffer(r["x"], "<u4")) for r in got], bits, **how)
    at = np.nonzero(w)[0]
    return Weights(bits, at, w[at], bias + float(np.log(share[0] / share[1])))


def _probability(model: Weights):
    dense = np.zeros(1 << model.bits, np.float32)
    dense[model.at] = model.w

    def run(texts: pa.Array) -> np.ndarray:
        n = len(texts)
        off, words = split_words(texts)
        h = _hashes(words)
        doc = np.repeat(np.arange(n), np.diff(off))
        hit = []
        for span, x in features(h, model.bits):
            at = np.nonzero(dense[x])[0]
            at = at[doc[at] == doc[at + span - 1]]
            hit.append(doc[at] * (1 << model.bits) + x[at])
        key = np.unique(np.concatenate(hit))
        s = np.bincount(key >> model.bits, weights=dense[key & ((1 << model.bits) - 1)], minlength=n) + model.bias
        return 1 / (1 + np.exp(-np.clip(s, -35, 35)))

    return run


def _score(model: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probability = _probability(model)
        for b in batches:
            texts = plain(b.column("text"))
            for lo, hi in text_slices(texts):
                yield pa.RecordBatch.from_arrays([b.column("id").slice(lo, hi - lo), pa.array(probability(texts.slice(lo, hi - lo)))], ["id", "score"])

    return run


def score(docs: DataFrame, model: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) for each row: the probability of label 1 by the whole text.

    Texts may be of any length.  A null, empty or blank text gets the score of the bias alone.  Repeated rows and null ids
    are scored like others; other columns are not read.  With labels of one class only, the
    score is near that class; with none, near 0.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_score(model), "id long, score double").withColumnRenamed("id", id_col)


def keep(docs: DataFrame, model: Weights, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs that score under `least`, all columns unchanged, whatever they are called.

    A null, empty or blank text has the score of the bias alone; texts may be of any length.
    Repeated rows are each kept or dropped alike; an empty table gives an empty table.
    """
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probability = _probability(model)
        for b in batches:
            texts = plain(b.column(place))
            for lo, hi in text_slices(texts):
                yield b.slice(lo, hi - lo).filter(pa.array(probability(texts.slice(lo, hi - lo)) < least))

    return docs.mapInArrow(tidy(run), docs.schema)
