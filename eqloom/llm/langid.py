"""Language identification: nearest of several TF-IDF centroids per language by cosine.

Texts become hashed counts of byte 2- and 3-grams of the lower-cased text with everything
that is no letter folded to one blank.  Counts are damped (1 + ln tf), weighted by idf and
scaled to unit length.  The centroids of each language come from spherical k-means on a
sample of labelled rows whose bound is a parameter.  A text whose best cosine is below
the least that the nearest centroid's own training texts reach (a low quantile) is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eqloom.llm.common import mix, plain, text_slices, unit_hash

DIM, PER_LANG, CENTROIDS, QUANTILE, STEP = 4096, 1500, 4, 0.002, 512



def gram_counts(texts: pa.Array, dim: int = DIM) -> np.ndarray:
    """(texts, dim) counts of hashed byte 2- and 3-grams."""
    low = pc.utf8_lower(texts)
    n = len(low)
    size = pc.binary_length(low).to_numpy(zero_copy_only=False).astype(np.int64)
    fold = np.arange(256, dtype=np.uint8)
    fold[:128] = 32
    fold[97:123] = np.arange(97, 123)
    flat = np.frombuffer(b"".join(low.cast(pa.large_binary()).to_pylist()), np.uint8)
    b = fold[flat].astype(np.uint32)
    doc = np.repeat(np.arange(n, dtype=np.int64), size)
    out = np.zeros(n * dim, np.int64)
    table = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(dim)).astype(np.uint16)
    step = mix(np.arange(1 << 8, dtype=np.uint64) + np.uint64(1 << 40)).astype(np.uint64) % np.uint64(dim)
    pair = (b[:-1] << 8) | b[1:] if len(b) > 1 else np.zeros(0, np.uint32)
    two = table[pair].astype(np.int64)
    same = doc[:-1] == doc[1:]
    blank = pair != (32 << 8 | 32)
    keep = same & blank
    out += np.bincount(doc[:-1][keep] * dim + two[keep], minlength=n * dim)
    if len(b) > 2:
        three = ((two[:-1] * 31 + step.astype(np.int64)[b[2:]]) + 7) % dim
        keep3 = keep[:-1] & same[1:]
        out += np.bincount(doc[:-2][keep3] * dim + three[keep3], minlength=n * dim)
    return out.reshape(n, dim)


@dataclass
class Centroids:
    langs: list[str]
    vectors: np.ndarray  # (centroids, dim), unit length
    owner: np.ndarray  # language of each centroid
    least: np.ndarray  # rejection bound of each centroid
    idf: np.ndarray


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = counts.astype(np.float32)
    np.log1p(x, out=x)
    x *= idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first starts."""
    c = [x.mean(axis=0)]
    near = x @ c[0]
    while len(c) < min(k, len(x)):
        c.append(x[int(np.argmin(near))])
        near = np.maximum(near, x @ c[-1])
    m = np.array(c)
    for _ in range(rounds):
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        at = np.argmax(x @ m.T, axis=1)
        m = np.array([x[at == j].mean(axis=0) if (at == j).any() else m[j] for j in range(len(m))])
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _sparse(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = plain(b.column("text"))
            # a slice of many short texts is counted in steps, as the counts are a row of dim numbers each
            for lo, hi in ((i, min(i + STEP, z)) for a, z in text_slices(texts) for i in range(a, z, STEP)):
                counts = gram_counts(texts.slice(lo, hi - lo), dim)
                rows = [np.nonzero(r)[0] for r in counts]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(lo, hi - lo), b.column("lang").slice(lo, hi - lo), pa.array([i.astype("<u2").tobytes() for i in rows], pa.binary()), pa.array([counts[d, i].astype("<u4").tobytes() for d, i in enumerate(rows)], pa.binary())],
                    ["id", "lang", "at", "n"],
                )

    return run


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, k: int = CENTROIDS, dim: int = DIM, quantile: float = QUANTILE) -> Centroids:
    """Fit on about per_lang rows of each language (a hash sample; never more than twice that)."""
    src = labelled.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    count = {r["lang"]: r["count"] for r in src.groupBy("lang").count().collect()}
    if not count:
        return Centroids([], np.zeros((0, dim), np.float32), np.zeros(0, int), np.zeros(0), np.ones(dim, np.float32))
    share = F.create_map(*[x for lang, n in count.items() for x in (F.lit(lang), F.lit(min(1.0, per_lang / n)))])
    sample = src.where(unit_hash("id") < F.try_element_at(share, F.col("lang"))).limit(2 * per_lang * len(count))
    got = sorted(sample.mapInArrow(_sparse(dim), "id long, lang string, at binary, n binary").collect(), key=lambda r: (r["lang"], r["id"] or 0))
    counts = np.zeros((len(got), dim), np.float32)
    for i, r in enumerate(got):
        counts[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["n"], "<u4")
    idf = (np.log((1 + len(got)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    x = vectors(counts, idf)
    name = np.array([r["lang"] for r in got])
    langs, cs, owner = sorted(set(name.tolist())), [], []
    for j, lang in enumerate(langs):
        m = _kmeans(x[name == lang], k)
        cs.append(m)
        owner += [j] * len(m)
    c, owner = np.concatenate(cs).astype(np.float32), np.array(owner)
    sim = x @ c.T
    best = sim.argmax(axis=1)
    top = sim.max(axis=1)
    least = np.array([np.quantile(top[best == j], quantile) if (best == j).any() else 0.0 for j in range(len(c))])
    return Centroids(langs, c, owner, least, idf)


def _score(model: Centroids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.langs, "und"], object)
        for b in batches:
            texts = plain(b.column("text"))
            letter = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)
            for lo, hi in text_slices(texts):
                yes = letter[lo:hi].astype(bool)
                if len(model.langs):
                    sim = np.concatenate([vectors(gram_counts(texts.slice(i, min(STEP, hi - i)), model.vectors.shape[1]), model.idf) @ model.vectors.T for i in range(lo, hi, STEP)])
                    best = sim.argmax(axis=1)
                    score = np.clip(sim[np.arange(hi - lo), best].astype(float), 0, 1)
                    lang, far = model.owner[best], score < model.least[best]
                else:
                    yes = np.zeros(hi - lo, bool)
                    score, lang, far = np.zeros(hi - lo), np.zeros(hi - lo, int), np.ones(hi - lo, bool)
                lang = np.where(yes, lang, len(model.langs))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(lo, hi - lo), pa.array(names[lang].tolist(), pa.string()), pa.array(np.where(yes, score, 0.0)), pa.array(far | ~yes)],
                    ["id", "lang_pred", "score", "rejected"],
                )

    return run


def identify(docs: DataFrame, model: Centroids, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, rejected) for each row.

    score is the cosine with the nearest centroid; rejected marks texts farther from it than
    nearly all of its training texts.  A null text, or one without a letter, or any text when
    nothing was learned, is `und` with score 0 and rejected.  Equal cosines go to the first
    language by name.  Texts may be of any length.  Repeated rows and null ids are scored like others.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_score(model), "id long, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)
