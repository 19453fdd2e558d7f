"""Benchmark decontamination by template canonicalisation.

Numbers, units after a number, and names (capitalised words inside a sentence) become typed
placeholders, other words lose case and outer punctuation.  A capitalised word that opens a
sentence is read both ways, as a word and as a name.  Windows of five canonical words of the
benchmark are hashed and joined with the windows of every document.  A document holds an item
if it has at least `coverage` of its windows, wherever they stand, or if it is near it in order:

- words changed, left out and put in are at most 1 - `coverage` of the item's words.  Such a copy
  always keeps a run of `surest` words, so these shorter windows find every candidate;
- or RUN words of the item follow each other unchanged, however long the item is.

Both are decided by aligning the words, with placeholders equal by kind, and need half of the
plain words of the item, or of the run, to be equal.  The values in the slots must
then agree with the item's slots one to one (the same value of the item always meets the
same value of the document, and the other way round), which keeps re-parameterised copies
and drops chance mixtures of templates: one conflict rejects a placement, whatever else agrees,
but for a run of RUN words within it that has the item's own values.
Windows that stand in several placements count together only if their slots agree together.

The index of the benchmark goes to the executors in chunks of at most `chunk` windows; a
larger benchmark is matched chunk by chunk, each against all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eqloom.llm.common import dictionary, mix, ngram_hashes, plain, split_words, text_slices, tidy

WINDOW, COVERAGE, CHUNK, RUN, BLOCK = 5, 0.8, 1_000_000, 13, 1 << 20
UNITS = "% mm cm m km in ft mi mg g kg t lb oz ml l s ms min h hz khz mhz ghz w kw v a pa k c f usd eur gbp dollars euros pounds cents meters metres kilometers kilometres miles feet inches grams kilograms liters litres seconds minutes hours days weeks months years percent degrees"
NUM, UNIT, NAME = 1, 2, 3


@dataclass
class Canon:
    h: np.ndarray  # hash of each canonical word
    kind: np.ndarray  # 0 word, 1 number, 2 unit, 3 name
    named: np.ndarray  # the same, where a capitalised word that opens a sentence is a name too
    value: np.ndarray  # hash of each word's value
    word: np.ndarray  # index into values
    values: list[bytes]
    offsets: np.ndarray


def canonical(texts: pa.Array) -> Canon:
    from xxhash import xxh3_64_intdigest as h

    units = set(UNITS.split())
    number = re.compile(r"[+-]?\d[\d.,:/]*%?")
    edge = ".,;:!?\"'()[]{}<>|*#&$-_~`"
    off, words = split_words(texts)
    idx, uniq = dictionary(words)
    hs, kinds, ends, values = np.zeros(len(uniq), np.uint64), np.zeros(len(uniq), np.int8), np.zeros(len(uniq), bool), []
    for i, u in enumerate(uniq):
        s = u.decode()
        w = s.strip(edge)
        low = w.lower()
        values.append(low.encode())
        ends[i] = s.rstrip("\"')]")[-1:] in {".", "!", "?", ":"}
        kinds[i] = -1 if not w else NUM if number.fullmatch(w) else UNIT if low in units else NAME if w[0].isupper() and len(w) > 1 and w[1:].islower() else 0
        hs[i] = h(values[i], 9)
    kind, end = kinds[idx], ends[idx]
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    first = np.ones(len(idx), bool)
    first[1:] = (doc[1:] != doc[:-1]) | end[:-1]
    full = kind >= 0
    opens = ((kind == NAME) & first)[full]
    offsets = np.concatenate([[0], np.cumsum(full)])[off]
    kind, word, doc = kind[full], idx[full], doc[full]
    after = np.zeros(len(kind), bool)
    after[1:] = (kind[:-1] == NUM) & (doc[1:] == doc[:-1])
    named = np.where((kind == UNIT) & ~after, 0, kind).astype(np.int8)
    kind = np.where(opens, 0, named).astype(np.int8)
    return Canon(np.where(kind > 0, kind.astype(np.uint64), hs[word]), kind, named, hs[word], word, values, offsets)


def opened(c: Canon, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that read differently where sentence openings are names: (index into starts, hash).

    Windows of placeholders only are left out, as any run of names would meet them.
    """
    new = np.concatenate([[0], np.cumsum(c.named != c.kind)])
    words = np.concatenate([[0], np.cumsum(c.named == 0)])
    pick = np.nonzero((new[starts + k] > new[starts]) & (words[starts + k] > words[starts]))[0]
    h = np.where(c.named > 0, c.named.astype(np.uint64), c.value)
    acc = np.zeros(len(pick), np.uint64)
    for j in range(k):
        acc = (acc ^ h[starts[pick] + j]) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    return pick, mix(acc)


@dataclass
class Index:
    hashes: np.ndarray  # sorted distinct window hashes
    start: np.ndarray  # postings of each
    item: np.ndarray
    pos: np.ndarray
    first: np.ndarray  # least position of an equal window
    ids: list
    size: np.ndarray  # distinct windows of each item
    slots: list[dict]  # position in the item -> (kind, value)
    soft: list[set]  # slots that may be no names: they open a sentence and stand nowhere inside one
    length: np.ndarray  # words of each item
    edits: np.ndarray  # changed words allowed in each item
    value: list[np.ndarray]  # hashes of the values of each item's words
    named: list[np.ndarray]  # kinds of each item's words
    bare: dict[bytes, list[int]]  # values of items that are placeholders only -> items
    seeds: dict[int, tuple]  # window size -> (hashes, start, item, pos), for items of a window or more


def surest(n: int, edits: int) -> int:
    """The longest run that n words keep at least, whatever `edits` of them are changed."""
    return -(-(n - edits) // (edits + 1))


def postings(m: np.ndarray) -> tuple:
    h = m[:, 0].view(np.uint64) if len(m) else np.zeros(0, np.uint64)
    o = np.argsort(h, kind="stable")
    u, start = np.unique(h[o], return_index=True)
    return u, np.append(start, len(h)), *m[o, 1:].T


def met(hashes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the windows h are in the index, and at which of its hashes."""
    if not len(hashes) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    slot = np.searchsorted(hashes, h)
    slot[slot == len(hashes)] = 0
    hit = np.nonzero(hashes[slot] == h)[0]
    return hit, slot[hit]


def expanded(start: np.ndarray, slot: np.ndarray, most: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index into slot, posting) of all postings of the slots, in blocks of about `most` rows."""
    n = start[slot + 1] - start[slot]
    ends = np.cumsum(n)
    lo = 0
    while lo < len(slot):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        m = n[lo:hi]
        post = np.repeat(start[slot[lo:hi]] - np.concatenate([[0], np.cumsum(m)])[:-1], m) + np.arange(m.sum())
        yield np.repeat(np.arange(lo, hi), m), post
        lo = hi


def windows_in(c: Canon, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the windows of k words inside each text, in both readings."""
    g = ngram_hashes(c.h, k)
    doc = np.repeat(np.arange(len(c.offsets) - 1), np.diff(c.offsets))
    starts = np.nonzero(doc[: len(g)] == doc[k - 1 :][: len(g)])[0] if len(g) else np.zeros(0, np.int64)
    extra, e = opened(c, starts, k)
    return np.concatenate([starts, starts[extra]]), np.concatenate([g[starts], e])


def align(value: np.ndarray, named: np.ndarray, value2: np.ndarray, named2: np.ndarray) -> tuple[int, list, list]:
    """Edits that turn an item into the nearest run of words of a text, its aligned words, and the longest equal run."""
    n, m = len(value), len(value2)
    j = np.arange(m + 1)
    cost, run, best, end = np.zeros((n + 1, m + 1), np.int32), np.zeros(m + 1, np.int32), 0, (0, 0)
    same = np.zeros((n, m), bool)
    for i in range(n):
        same[i] = (value2 == value[i]) | ((named2 == named[i]) & (named[i] > 0))
        row = cost[i] + 1
        row[1:] = np.minimum(row[1:], cost[i, :-1] + ~same[i])
        cost[i + 1] = np.minimum.accumulate(row - j) + j
        run[1:] = np.where(same[i], run[:-1] + 1, 0)
        if (top := int(run.argmax())) and run[top] > best:
            best, end = int(run[top]), (i + 1, top)
    x, y = n, int(cost[n].argmin())
    edits, pairs = int(cost[n, y]), []
    while x:
        if y and cost[x, y] == cost[x - 1, y - 1] + (not same[x - 1, y - 1]):
            x, y = x - 1, y - 1
            if same[x, y]:
                pairs.append((x, y))
        elif cost[x, y] == cost[x - 1, y] + 1:
            x -= 1
        else:
            y -= 1
    return edits, pairs[::-1], [(end[0] - r, end[1] - r) for r in range(best, 0, -1)]


def windows_of(c: Canon, d: int, k: int) -> np.ndarray:
    a, z = c.offsets[d], c.offsets[d + 1]
    return ngram_hashes(c.h[a:z], k) if z - a >= k else ngram_hashes(c.h[a:z], z - a) if z > a else c.h[:0]


def build_index(items: list[tuple], k: int, coverage: float = COVERAGE) -> Index:
    c = canonical(plain(pa.array([t for _, t in items], pa.string())))
    rows, size, slots, soft, length, edits, value, named = [], [], [], [], [], [], [], []
    seeds: dict[int, list] = {}
    bare: dict[bytes, list[int]] = {}
    for d in range(len(items)):
        w = windows_of(c, d, k)
        a, z = c.offsets[d], c.offsets[d + 1]
        size.append(max(1, len(np.unique(w))))
        length.append(z - a)
        edits.append(int((1 - coverage) * (z - a) + 1e-9))
        value.append(c.value[a:z])
        named.append(c.named[a:z])
        slots.append({int(p - a): (int(c.named[p]), c.values[c.word[p]]) for p in range(a, z) if c.named[p]})
        names = {c.values[c.word[p]] for p in range(a, z) if c.kind[p] == NAME}
        soft.append({p for p, (_, v) in slots[-1].items() if not c.kind[a + p] and v not in names})
        if z > a and c.kind[a:z].all():  # its canonical words say nothing, its values do
            bare.setdefault(c.value[a:z].tobytes(), []).append(d)
        elif z > a:
            same = np.unique(w, return_index=True, return_inverse=True)
            first = same[1][same[2]]  # a window that the item repeats counts once
            rows.append(np.column_stack([w.view(np.int64), np.full(len(w), d), np.arange(len(w)), first]))
            if z - a >= k:
                short = min(surest(z - a, edits[-1]), RUN)
                at, g = opened(c, np.arange(a, z - short + 1), short)
                both = np.concatenate([ngram_hashes(c.h[a:z], short), g]), np.concatenate([np.arange(z - a - short + 1), at])
                seeds.setdefault(short, []).append(np.column_stack([both[0].view(np.int64), np.full(len(both[0]), d), both[1]]))
                at, g = opened(c, np.arange(a, z - k + 1), k)
                rows.append(np.column_stack([g.view(np.int64), np.full(len(g), d), at, first[at]]))
    m = np.concatenate(rows) if rows else np.zeros((0, 4), np.int64)
    found = {n: postings(np.concatenate(r)) for n, r in seeds.items()}
    return Index(*postings(m), [i for i, _ in items], np.array(size), slots, soft, np.array(length), np.array(edits), value, named, bare, found)


class Tie:
    """A one-to-one tie between the slot values of an item and those of a document."""

    def __init__(self) -> None:
        self.to: dict = {}
        self.back: dict = {}
        self.slots = 0
        self.same = True

    def add(self, met: list[tuple[int, bytes, bytes]]) -> bool:
        """Take in (kind, value of the item, value of the document) of some slots, or none of them if one conflicts."""
        to, back = {}, {}
        for kind, v, w in met:
            mine, other = (kind, v), (kind, w)
            if self.to.get(mine, to.setdefault(mine, other)) != other or self.back.get(other, back.setdefault(other, mine)) != mine or to[mine] != other or back[other] != mine:
                return False
        self.to |= to
        self.back |= back
        self.slots += len(met)
        self.same &= all(v == w for _, v, w in met)
        return True


def facing(ix: Index, c: Canon, i: int, pairs: list[tuple[int, int]]) -> list[tuple[int, bytes, bytes]]:
    """(kind, value of the item, value of the text) of the slots among (item position, text position).

    A word that opens a sentence and is no name elsewhere counts as a slot only if its value changed.
    """
    out = []
    for x, y in pairs:
        kind, v = ix.slots[i].get(x, (0, b""))
        if kind and c.named[y] == kind:
            w = c.values[c.word[y]]
            if v != w or x not in ix.soft[i]:
                out.append((kind, v, w))
    return out


def _near(ix: Index, c: Canon, doc: np.ndarray, done: set, k: int) -> Iterator[tuple]:
    """(pair, share, slots, match) of the items that texts hold with edits or in a long run, but for the pairs done."""
    found: dict[int, tuple] = {}
    for size, (hashes, start, item, pos) in ix.seeds.items():
        at, h = windows_in(c, size)
        hit, slot = met(hashes, h)
        order = np.argsort(at[hit], kind="stable")
        at, slot = at[hit][order], slot[order]
        for row, post in expanded(start, slot):
            seeds = np.unique(np.column_stack([doc[at[row]] * len(ix.ids) + item[post], at[row] - pos[post]]), axis=0)
            first = np.nonzero(np.diff(seeds[:, 0], prepend=-1))[0]
            for f, t in zip(first.tolist(), [*first[1:].tolist(), len(seeds)]):
                p = int(seeds[f, 0])
                if p in done:
                    continue
                d, i = divmod(p, len(ix.ids))
                n, e = int(ix.length[i]), int(ix.edits[i])
                a, z = int(c.offsets[d]), int(c.offsets[d + 1])
                end = -1
                for shift in seeds[f:t, 1].tolist():
                    if min(z, shift + n + e) <= end:
                        continue
                    # room for further seeds of the pair; the next stretch overlaps by all that one copy may take
                    lo, end = max(a, shift - e), min(z, shift + 2 * n)
                    if (v := _verdict(ix, c, i, lo, end)) and (p not in found or v[0] > found[p][0]):
                        found[p] = v
    for p in sorted(found):
        yield p, *found[p]


def _verdict(ix: Index, c: Canon, i: int, lo: int, hi: int) -> tuple | None:
    """(share, slots, match) if words lo to hi hold item i with few edits or a long run of it, slots agreeing."""
    value, named, n = ix.value[i], ix.named[i], int(ix.length[i])
    value2, named2 = c.value[lo:hi], c.named[lo:hi]
    known = np.isin(value, value2) | ((named > 0) & np.isin(named, named2))
    gaps = np.diff(np.concatenate([[-1], np.nonzero(~known)[0], [n]])) - 1
    if known.sum() < n - ix.edits[i] and gaps.max() < RUN:
        return None
    edits, near, run = align(value, named, value2, named2)
    for pairs, whole in ((near, True), (run, False)):
        if whole and edits > ix.edits[i]:
            continue
        kept, tie = _agreeing(ix, c, i, [(x, lo + y) for x, y in pairs], whole)
        if not whole and len(kept) < RUN:
            continue
        words = n - int((named > 0).sum()) if whole else sum(named[x] == 0 for x, _ in kept)
        equal = sum(named[x] == 0 for x, _ in kept)
        if equal and 2 * equal >= words:
            return 1 - edits / n if whole else len(kept) / n, tie.slots, "verbatim" if tie.same else "template"
    return None


def _agreeing(ix: Index, c: Canon, i: int, pairs: list, whole: bool) -> tuple[list, Tie]:
    """The aligned words if their slots agree; of a run whose slots don't, its longest stretch with the item's own values."""
    tie = Tie()
    if tie.add(facing(ix, c, i, pairs)):
        return pairs, tie
    best: list = []
    if not whole:
        lo = 0
        for hi in range(1, len(pairs) + 1):
            if any(v != w for _, v, w in facing(ix, c, i, pairs[hi - 1 : hi])):
                lo = hi
            if hi - lo > len(best):
                best = pairs[lo:hi]
    tie.add(facing(ix, c, i, best))
    return best, tie


def _bare(ix: Index, c: Canon, doc: np.ndarray, k: int) -> set[tuple[int, int]]:
    """(text, item) where a whole run of placeholders has the values of an item that is placeholders only."""
    if not ix.bare:
        return set()
    full = c.kind > 0
    cut = np.ones(len(full) + 1, bool)
    cut[1:-1] = (full[1:] != full[:-1]) | (doc[1:] != doc[:-1])
    edge = np.nonzero(cut)[0]
    start, end = edge[:-1], edge[1:]
    n = end - start
    pick = full[start] & np.isin(n, [len(b) // 8 for b in ix.bare]) if len(start) else np.zeros(0, bool)
    pick[pick] &= (n[pick] >= k) | (n[pick] == np.diff(c.offsets)[doc[start[pick]]])
    return {(int(doc[a]), i) for a, z in zip(start[pick], end[pick]) for i in ix.bare.get(c.value[a:z].tobytes(), ())}


def _match(ix: Index, k: int, coverage: float):
    def shared(c: Canon, doc: np.ndarray, at: np.ndarray, h: np.ndarray) -> Iterator[tuple]:
        """(pair, share, slots, match) of the items with enough windows in a text, in placements that agree."""
        hit, slot = met(ix.hashes, h)
        at = at[hit]
        # a window that a text repeats is looked up once
        once = np.unique(np.column_stack([doc[at], slot]), axis=0)
        found = [np.unique(np.column_stack([once[row, 0] * len(ix.ids) + ix.item[post], ix.first[post]]), axis=0) for row, post in expanded(ix.start, once[:, 1])]
        found = np.unique(np.concatenate(found), axis=0)[:, 0] if found else np.zeros(0, np.int64)
        key, count = np.unique(found, return_counts=True)
        if not len(key):
            return
        order = np.argsort(doc[at], kind="stable")
        at, slot = at[order], slot[order]
        edge = np.searchsorted(doc[at], np.arange(len(c.offsets)))
        for p in key[count / ix.size[key % len(ix.ids)] >= coverage].tolist():
            d, i = divmod(p, len(ix.ids))
            mine = slice(edge[d], edge[d + 1])
            post = [(a, q) for a, s in zip(at[mine].tolist(), slot[mine].tolist()) for q in range(ix.start[s], ix.start[s + 1]) if ix.item[q] == i]
            placed: dict[int, list] = {}
            for a, q in post:
                placed.setdefault(a - int(ix.pos[q]), []).append(q)
            tie, held = Tie(), set()
            for shift in sorted(placed, key=lambda s: (-len(placed[s]), s)):
                places = {x for q in placed[shift] for x in range(ix.pos[q], min(ix.pos[q] + k, ix.length[i]))}
                if tie.add(facing(ix, c, i, [(x, x + shift) for x in sorted(places)])):
                    held |= {int(ix.first[q]) for q in placed[shift]}
            if len(held) / ix.size[i] >= coverage:
                yield p, len(held) / float(ix.size[i]), tie.slots, "verbatim" if tie.same else "template"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = plain(b.column("text")), b.column("id").to_pylist()
            for lo, hi in text_slices(texts):
                c = canonical(texts.slice(lo, hi - lo))
                doc = np.repeat(np.arange(hi - lo), np.diff(c.offsets))
                short = [d for d in range(hi - lo) if 0 < c.offsets[d + 1] - c.offsets[d] < k]
                at, h = windows_in(c, k)
                h = np.concatenate([h, *[windows_of(c, d, k) for d in short]])
                at = np.concatenate([at, *[[c.offsets[d]] for d in short]]).astype(np.int64)
                whole = list(shared(c, doc, at, h))
                rows = whole + list(_near(ix, c, doc, {p for p, *_ in whole}, k))
                rows += [(d * len(ix.ids) + i, 1.0, int(ix.length[i]), "verbatim") for d, i in sorted(_bare(ix, c, doc, k))]
                cols = list(zip(*rows)) if rows else [[]] * 4
                out = [[ids[lo + p // len(ix.ids)] for p in cols[0]], [ix.ids[p % len(ix.ids)] for p in cols[0]], *map(list, cols[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.string()))], ["id", "item", "coverage", "slots", "match"])

    return tidy(run)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, coverage: float = COVERAGE, chunk: int = CHUNK) -> DataFrame:
    """(id_col, item_col, coverage, slots, match): a row for each document and item it holds.

    coverage is the share of the item's distinct windows in the document or, where that is too
    small, of its words without the edits or in the longest run; match is verbatim,
    or template where slots hold other values.  Null, empty and blank texts match nothing, on
    either side; a document or item shorter than a window is one window.  An item of placeholders
    only (a row of numbers) has no template: it is found by its values, where they are a whole
    run of placeholders in the document, not a stretch of a longer one.  Items with a null
    id are left out; a document with a null id is reported under null.  Repeated rows are
    matched each; of several placements the one with most windows counts first, then the earliest.
    Texts may be of any length, and a window that many items share is looked up in blocks.  Only the named columns are read.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null").dropDuplicates().orderBy("i", "t")
    schema = "id long, item long, coverage double, slots long, match string"
    out, held, words = None, [], 0

    def add(out: DataFrame | None) -> DataFrame:
        found = src.mapInArrow(_match(build_index(held, window, coverage), window, coverage), schema)
        return found if out is None else out.unionByName(found)

    for r in items.toLocalIterator():
        held.append((r["i"], r["t"]))
        words += len(r["t"].split())
        if words >= chunk:
            out, held, words = add(out), [], 0
    if held:
        out = add(out)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})
