"""Removal of repeated passages: within a corpus, and against a bounded reference.

`cut_reference` is the broadcast form: suffix automata of reference shards of bounded size,
documents streamed through each for matching statistics, maximal spans of at least
`window` words removed.

`repeated_spans` is for a corpus that is its own reference.  There the automata would have
to hold the corpus, which no broadcast may, and every document would meet every shard; so
windows are matched by anchors instead:

1. The anchor of a window is the least of its 8-word hashes; equal windows have equal
   anchors, and about one word in seven starts one.  A first pass counts anchors.
2. A bitmap of fixed size of the anchors that occur twice lets a second pass emit only the
   segments (runs of windows with one anchor) that can repeat; a full bitmap only costs rows.
3. Equal segments: all but the earliest are covered.  Where an anchor has different
   segments, a third pass emits the windows of their earliest copies, and those join by hash.
All groups are settled by map-side minima, so a passage in a third of all documents is one
row a task; segments and windows are equal if two independent 64-bit hashes are (the anchor's
and their own), and rows of very common ones are joined where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eqloom.llm.common import as_long, bitmap, discard, join_counted, materialize, mix, ngram_hashes, on_few, plain, split_words, text_slices, word_hashes

WINDOW, GRAM, BITS, SHARD = 20, 8, 25, 200_000


def segments(h: np.ndarray, off: np.ndarray, window: int, gram: int) -> tuple:
    """Runs of windows that share an anchor: (document, first word, windows, anchor, segment hash), and all window hashes."""
    g = ngram_hashes(h, gram)
    n = len(h) - window + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64), z.astype(np.uint64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    wide = window - gram + 1
    at = np.lib.stride_tricks.sliding_window_view(mix(g + np.uint64(1)), wide).argmin(axis=1) + np.arange(n)
    win = np.zeros(n, np.uint64)
    for j in [*range(0, window - gram, gram), window - gram]:
        win = mix((win ^ g[j : j + n]) * np.uint64(0x9E3779B97F4A7C15))
    inside = np.nonzero(doc[:n] == doc[window - 1 :])[0]
    a, d = at[inside], doc[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
    s = np.nonzero(new)[0]
    size = np.diff(np.append(s, len(inside)))
    first, last = inside[s], inside[s] + size - 1
    seg = mix((win[first] * np.uint64(0x9E3779B97F4A7C15)) ^ mix(win[last] + size.astype(np.uint64)))
    return d[s], first, size, g[a[s]], seg, win


def _anchors(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = plain(b.column("text"))
            for lo, hi in text_slices(texts):
                off, words = split_words(texts.slice(lo, hi - lo))
                anchor, n = np.unique(segments(word_hashes(words), off, window, gram)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([as_long(anchor), pa.array(n)], ["anchor", "n"])

    return run


def _has(held: np.ndarray, bits: int, key: np.ndarray) -> np.ndarray:
    x = (key.astype(np.uint64) & np.uint64((1 << bits) - 1)).astype(np.int64)
    return ((held[x >> 3] >> (x & 7).astype(np.uint8)) & 1).astype(bool)


def _segments(held: np.ndarray, bits: int, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = plain(b.column("text"))
            for lo, hi in text_slices(texts):
                off, words = split_words(texts.slice(lo, hi - lo))
                d, first, size, anchor, seg, _ = segments(word_hashes(words), off, window, gram)
                hit = _has(held, bits, anchor)
                d, first = d[hit], first[hit]
                row = pa.array(d + lo)
                yield pa.RecordBatch.from_arrays([as_long(anchor[hit]), as_long(seg[hit]), b.column("id").take(row), b.column("fp").take(row), pa.array(first - off[d], pa.int32()), pa.array(size[hit], pa.int32())], ["anchor", "seg", "id", "fp", "start", "size"])

    return run


def _windows(held: np.ndarray, bits: int, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = plain(b.column("text")), pc.fill_null(b.column("id"), 0).to_numpy()
            for lo, hi in text_slices(texts):
                off, words = split_words(texts.slice(lo, hi - lo))
                d, first, size, anchor, seg, win = segments(word_hashes(words), off, window, gram)
                hit = _has(held, bits, seg.view(np.int64) ^ ids[lo + d] ^ ((first - off[d]) << 7))
                d, first, size = d[hit], first[hit], size[hit]
                ends = np.concatenate([[0], np.cumsum(size)])
                flat = win[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])]
                row = pa.array(d + lo)
                yield pa.RecordBatch.from_arrays(
                    [as_long(anchor[hit]), b.column("id").take(row), b.column("fp").take(row), pa.array(first - off[d], pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), as_long(flat))],
                    ["anchor", "id", "fp", "start", "wins"],
                )

    return run


def repeated_spans(src: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = BITS) -> DataFrame:
    """(id, fp, spans) of each row (id, fp, text) with words to remove; a span is [from, to) in words."""
    counts = src.select("text").mapInArrow(_anchors(window, gram), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    held = bitmap(counts.select(F.col("anchor").alias("key")), bits)
    rows = materialize(src.mapInArrow(_segments(held, bits, window, gram), "anchor long, seg long, id long, fp long, start int, size int"), "segments")
    pos = F.struct("id", "start", "fp")
    first = materialize(rows.groupBy("anchor", "seg").agg(F.min(pos).alias("first"), F.count(F.lit(1)).alias("n")), "first")
    later = join_counted(rows, first.where("n > 1"), ["anchor", "seg"]).where(pos != F.col("first")).select("id", "fp", "start", (F.col("start") + F.col("size") + window - 1).alias("end"))
    mixed = materialize(first.groupBy("anchor").agg(F.min("seg").alias("a"), F.max("seg").alias("b"), F.count(F.lit(1)).alias("m")).where("a <> b").select("anchor", "m"), "anchors")
    need = materialize(join_counted(first, mixed, ["anchor"], "m").select("seg", "first.*"), "mixed")
    key = F.col("seg").bitwiseXOR(F.coalesce("id", F.lit(0))).bitwiseXOR(F.shiftleft(F.col("start").cast("long"), 7))
    found = src.mapInArrow(_windows(bitmap(need.select(key.alias("key")), bits), bits, window, gram), "anchor long, id long, fp long, start int, wins array<long>")
    # a chance hit of the bitmap is another true segment, so it may take part
    each = materialize(found.select("anchor", "id", F.posexplode("wins").alias("o", "win"), "fp", "start").select("id", (F.col("start") + F.col("o")).alias("start"), "fp", "anchor", "win"), "windows")
    least = materialize(each.groupBy("anchor", "win").agg(F.min(pos).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "least")
    single = join_counted(each, least, ["anchor", "win"]).where(pos != F.col("first")).select("id", "fp", "start", (F.col("start") + window).alias("end"))
    out = materialize(later.unionByName(single).groupBy("id", "fp").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")
    discard(rows, first, mixed, need, each, least)
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, spans = plain(b.column("text")), b.column("spans")
        for lo, hi in text_slices(texts):
            off, words = split_words(texts.slice(lo, hi - lo))
            keep = np.ones(len(words), bool)
            for d in range(hi - lo):
                for s in spans[lo + d].as_py() or ():
                    keep[off[d] + s["start"] : off[d] + s["end"]] = False
            at = np.concatenate([[0], np.cumsum(keep)])[off]
            left = (words if keep.all() else words.filter(pa.array(keep))).cast(pa.string())
            kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), left), " ")
            n = np.diff(off)
            yield pa.RecordBatch.from_arrays([b.column("id").slice(lo, hi - lo), pa.array(n), pa.array(n - np.diff(at)), kept], ["id", "n_words", "n_removed", "kept"])


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id_col, n_words, n_removed, kept) for each row.

    A word goes if a window of `window` words over it also starts earlier: in a document of
    smaller id, or earlier in the same one.  Windows are judged on the input.  kept is the
    other words joined by a blank.  A null, empty or blank text has no words and stays empty;
    a text shorter than a window loses none.  Rows that repeat id and text count as one
    document; texts under one id are ordered by the place of the window.  A null id comes first.
    Texts may be of any length.  Other columns are not read.  An empty table gives an empty table.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("fp", F.xxhash64("text"))
    spans = repeated_spans(src, window).withColumnsRenamed({"id": "_i", "fp": "_f"})
    joined = lambda d: d.join(spans, F.col("id").eqNullSafe(F.col("_i")) & (F.col("fp") == F.col("_f")), "left").select("id", "text", "spans")
    whole = lambda d: d.select("id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    both = on_few(src, F.xxhash64("id", "fp"), spans, F.xxhash64("_i", "_f"), joined, whole)
    return both.mapInArrow(_cut, "id long, n_words long, n_removed long, kept string").withColumnRenamed("id", id_col)


class SuffixAutomaton:
    """Suffix automaton of word sequences, in arrays of dictionaries; matches never cross sequences."""

    def __init__(self, sequences: list[list[str]]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        for s in sequences:
            last = 0
            for w in s:
                last = self._extend(last, w)

    def _split(self, p: int, q: int, w: str) -> int:
        c = len(self.size)
        self.next.append(dict(self.next[q]))
        self.size.append(self.size[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: str) -> int:
        if w in self.next[last]:  # the sequence's beginning is known already
            q = self.next[last][w]
            return q if self.size[q] == self.size[last] + 1 else self._split(last, q, w)
        cur = len(self.size)
        self.next.append({})
        self.size.append(self.size[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, w)
        return cur

    def matching_statistics(self, words: list[str]) -> list[int]:
        """For each word, the length of the longest run ending there that the reference holds."""
        out, state, n = [], 0, 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.size[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
            else:
                n = 0
            out.append(n)
        return out


def _reference(automaton: SuffixAutomaton, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        for b in batches:
            spans = []
            for t in plain(b.column("text")).to_pylist():
                found: list[dict] = []
                for end, n in enumerate(automaton.matching_statistics(re.findall(r"[^\x20\x09-\x0D]+", t)), 1):
                    if n >= window:
                        if found and end - n <= found[-1]["end"]:
                            found[-1]["end"] = end
                        else:
                            found.append({"start": end - n, "end": end})
                spans.append(found)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["row", "spans"])

    return run


def cut_reference(docs: DataFrame, reference: DataFrame, id_col: str = "doc_id", text_col: str = "text", reference_col: str = "text", window: int = WINDOW, shard_words: int = SHARD) -> DataFrame:
    """(id_col, n_words, n_removed, kept): documents without their maximal spans of at least `window` words that stand in the reference.

    The reference is read in shards of about shard_words words; each shard's automaton is
    broadcast and dropped again, so driver and executors hold one shard at a time, and a
    reference of any size is only more passes.  Null and empty texts as in dedup_passages, on either
    side; texts may be of any length, but a reference text is never split over shards.  Repeated rows
    are each cut.  Other columns are not read.  An empty table gives an empty table.
    """
    import re

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    src = materialize(src.withColumn("row", F.monotonically_increasing_id()), "cut")
    found, held, n = None, [], 0

    def shard(found: DataFrame | None) -> DataFrame:
        spans = materialize(src.select("row", "text").mapInArrow(_reference(SuffixAutomaton(held), window), "row long, spans array<struct<start: bigint, end: bigint>>").where(F.size("spans") > 0), "spans")
        return spans if found is None else found.unionByName(spans)

    for r in reference.select(F.col(reference_col).cast("string").alias("t")).where("t is not null").toLocalIterator():
        held.append(re.findall(r"[^\x20\x09-\x0D]+", r["t"]))
        n += len(held[-1])
        if n >= shard_words:
            found, held, n = shard(found), [], 0
    if held or found is None:
        found = shard(found)
    spans = found.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return src.join(spans, "row", "left").select("id", "text", "spans").mapInArrow(_cut, "id long, n_words long, n_removed long, kept string").withColumnRenamed("id", id_col)
