"""Quality scores: a generalised additive model with pairwise interactions.

Each text becomes a score of numbers (byte classes, word and line repetition, lengths),
binned at quantiles of the training sample.  Cyclic boosting visits one feature after the
other and adds a shallow tree's step function to that feature's lookup table; then the
pairs with the largest gain on what is left are boosted in the same way on coarse
two-dimensional tables.  Scoring is a sum of table look-ups by bin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eqloom.llm.common import plain, split_words, text_slices
from eqloom.llm.toxicity import class_sample

PER_CLASS, BINS, PAIR_BINS, PAIRS = 10_000, 32, 8, 6
NAMES = ["words", "word_chars", "long_words", "short_words", "upper", "digits", "marks", "stops", "bangs", "bars", "blanks", "high_bytes", "unique_words", "top_word", "same_next", "lines", "line_words", "unique_lines", "marked_words"]


def _by_doc(doc: np.ndarray, idx: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document, and the count of its commonest."""
    if not len(idx):
        return np.zeros(n), np.zeros(n)
    key, count = np.unique(doc * (int(idx.max()) + 1) + idx, return_counts=True)
    d = key // (int(idx.max()) + 1)
    top = np.zeros(n)
    np.maximum.at(top, d, count)
    return np.bincount(d, minlength=n).astype(float), top


def measure(texts: pa.Array) -> np.ndarray:
    """(texts, features): the numbers named in NAMES."""
    n = len(texts)
    kind = np.zeros(256, np.uint8)
    for k, chars in enumerate((range(65, 91), range(48, 58), b"#$%&*^~=+<>{}[]\\/@_`", b".,;:?", b"!", b"|", b" \t\n\r\v\f", range(128, 256)), 1):
        kind[list(chars)] = k
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = kind[np.frombuffer(b"".join(texts.cast(pa.large_binary()).to_pylist()), np.uint8)]
    doc = np.repeat(np.arange(n, dtype=np.int64) * 16, size)
    cls = np.bincount(doc + flat, minlength=n * 16).reshape(n, 16)[:, 1:9] / np.maximum(size, 1)[:, None]
    off, words = split_words(texts)
    nw = np.diff(off)
    wdoc = np.repeat(np.arange(n, dtype=np.int64), nw)
    idx = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    wlen = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(float)
    per = lambda v: np.bincount(wdoc, weights=v, minlength=n) / np.maximum(nw, 1)
    uniq, top = _by_doc(wdoc, idx, n)
    same = np.zeros(len(idx))
    if len(idx) > 1:
        same[1:] = (idx[1:] == idx[:-1]) & (wdoc[1:] == wdoc[:-1])
    marked = pc.match_substring_regex(words, r"[^\pL\pN]$").to_numpy(zero_copy_only=False).astype(float) if len(words) else np.zeros(0)
    lists = pc.split_pattern(texts, "\n")
    nl = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    lidx = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ul, _ = _by_doc(np.repeat(np.arange(n, dtype=np.int64), nl), lidx, n)
    return np.column_stack([np.log1p(nw), per(wlen), per(wlen > 9), per(wlen <= 3), cls, uniq / np.maximum(nw, 1), top / np.maximum(nw, 1), per(same), np.log1p(nl), nw / np.maximum(nl, 1), ul / np.maximum(nl, 1), per(marked)])


@dataclass
class Tables:
    edges: list[np.ndarray]  # of each feature
    main: list[np.ndarray]  # of each feature, by bin
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]  # two features and a table by both bins
    bias: float


def _step(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """A tree on a binned feature: at most `leaves` ranges of bins, Newton value of each."""
    cuts = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    val = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1)
    for _ in range(leaves - 1):
        best = max(((val(a, m) + val(m, b) - val(a, b), m) for a, b in zip(cuts[:-1], cuts[1:]) for m in range(a + 1, b)), default=(0, 0))
        if best[0] <= 1e-9:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1)
    return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, bins: int = BINS, pair_bins: int = PAIR_BINS, pairs: int = PAIRS, pair_rounds: int = 40) -> Tables:
    """Fit the tables on feature rows x and labels y (0 or 1), both present."""
    m = x.shape[1]
    cut = lambda k: [np.unique(np.quantile(x[:, j], np.arange(1, k) / k)) for j in range(m)]
    edges, pair_edges = cut(bins), cut(pair_bins)
    b = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    c = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(pair_edges)]
    main = [np.zeros(len(e) + 1) for e in edges]
    bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    f = np.full(len(y), bias)
    prob = lambda: 1 / (1 + np.exp(-f))
    for _ in range(rounds):
        for j in range(m):
            p = prob()
            t = rate * _step(np.bincount(b[j], y - p, len(main[j])), np.bincount(b[j], p * (1 - p), len(main[j])), 3)
            main[j] += t
            f += t[b[j]]
    p = prob()
    grid = lambda i, j, v: np.bincount(c[i] * (len(pair_edges[j]) + 1) + c[j], v, (len(pair_edges[i]) + 1) * (len(pair_edges[j]) + 1))
    gain = sorted(((float((grid(i, j, y - p) ** 2 / (grid(i, j, p * (1 - p)) + 5)).sum()), i, j) for i in range(m) for j in range(i + 1, m)), reverse=True)[:pairs]
    found = [(i, j, np.zeros((len(pair_edges[i]) + 1) * (len(pair_edges[j]) + 1))) for _, i, j in gain]
    for _ in range(pair_rounds):
        for i, j, t in found:
            p = prob()
            s = rate * grid(i, j, y - p) / (grid(i, j, p * (1 - p)) + 5)
            t += s
            f += s[c[i] * (len(pair_edges[j]) + 1) + c[j]]
    return Tables(edges, main, pair_edges, found, bias)


def predict(x: np.ndarray, t: Tables) -> np.ndarray:
    f = np.full(len(x), t.bias)
    c = {}
    for j, (e, v) in enumerate(zip(t.edges, t.main)):
        f += v[np.searchsorted(e, x[:, j], side="right")]
    for i, j, v in t.pairs:
        for k in (i, j):
            if k not in c:
                c[k] = np.searchsorted(t.pair_edges[k], x[:, k], side="right")
        f += v[c[i] * (len(t.pair_edges[j]) + 1) + c[j]]
    return 1 / (1 + np.exp(-np.clip(f, -35, 35)))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = plain(b.column("text"))
        for lo, hi in text_slices(texts):
            x = measure(texts.slice(lo, hi - lo))
            yield pa.RecordBatch.from_arrays([b.column("id").slice(lo, hi - lo), b.column("y").slice(lo, hi - lo), pa.array(list(x), pa.list_(pa.float64()))], ["id", "y", "x"])


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, **how) -> Tables:
    """Fit on about per_class labelled rows of each class (a row is 19 numbers); null labels are left out, of several of an id the largest holds."""
    y = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    y, share = class_sample(y, per_class)
    if len(share) < 2:
        return Tables([], [], [], [], 5.0 if 1 in share else -5.0)
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(y), "id")
    got = sorted((r["id"], r["y"], r["x"]) for r in text.mapInArrow(_rows, "id long, y int, x array<double>").collect())
    if len({r[1] for r in got}) < 2:
        return Tables([], [], [], [], 5.0 if got and got[0][1] else -5.0)
    t = boost(np.array([r[2] for r in got]), np.array([r[1] for r in got], float), **how)
    t.bias += float(np.log(share[0] / share[1]))
    return t


def _score(model: Tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = plain(b.column("text"))
            for lo, hi in text_slices(texts):
                p = predict(measure(texts.slice(lo, hi - lo)), model)
                yield pa.RecordBatch.from_arrays([b.column("id").slice(lo, hi - lo), pa.array(p)], ["id", "score"])

    return run


def score(docs: DataFrame, model: Tables, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) for each row: the probability of label 1 by the whole text.

    Texts may be of any length.  Null, empty and blank texts are scored by their (zero) features.  Repeated rows and null
    ids are scored like others; other columns are not read.  With labels of one class only,
    the score is near that class; with none, near 0.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_score(model), "id long, score double").withColumnRenamed("id", id_col)
