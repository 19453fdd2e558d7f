"""Packing token sequences by Karmarkar-Karp multiway differencing.

Documents are tokenised once; each is cut into full pieces of `capacity` tokens, which are
sequences of their own without padding, and a remainder in pieces of at most `piece`
tokens: smaller pieces balance better.  These are dealt by hash into groups of bounded size and each group is split into windows by the largest
differencing method: partial partitions are merged, the one with the largest spread first,
so that the heavy slots of one meet the light slots of the other.  A group starts with
ceil(tokens / capacity) windows; while a window exceeds the capacity, one more is added.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eqloom.llm.common import kept_state, materialize, plain, split_words, text_slices, tidy

CAPACITY, END_ID, PIECE = 4096, 2, 1024
GROUP_WINDOWS, GROUP_PIECES, CACHE, ALONE = 128, 8192, 250_000, 1024
# letters and digits that neither fold nor compose into something with a mark at its end
WORD_END = "[0-9A-Za-z\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{12F}\\x{131}-\\x{17F}\\x{400}-\\x{481}\\x{3041}-\\x{3096}\\x{30A1}-\\x{30FA}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7A3}]$"
# ASCII and the precomposed Latin letters up to U+017F, but for the dotted capital I
PLAIN = "^[\\x00-\\x7F\\x{C0}-\\x{12F}\\x{131}-\\x{17F}]*$"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indexes of the sizes in k subsets of nearly equal sums (multiway Karmarkar-Karp)."""
    left, right = [-1] * len(sizes), [-1] * len(sizes)
    heap = [(-s if k > 1 else 0, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - k  # slots where both have something; lists ascend
        if over <= 0:
            merged = sorted(a + b)
        else:
            merged = a[over:] + b[over:]
            for (x, i), (y, j) in zip(a[:over][::-1], b[:over]):
                left.append(i)
                right.append(j)
                merged.append((x + y, len(left) - 1))
            merged.sort()
        heapq.heappush(heap, ((merged[0][0] if len(merged) == k else 0) - merged[-1][0], tick, merged))
        tick += 1
    out = []
    for _, node in heap[0][2] if heap else []:
        members, stack = [], [node]
        while stack:
            x = stack.pop()
            if left[x] < 0:
                members.append(x)
            else:
                stack += [left[x], right[x]]
        out.append(sorted(members))
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return found
        k += 1


def _encoder(path: str):
    """Words to ids by the tokenizer, with a bounded cache a worker keeps between tasks.

    White space always parts tokens, and so does a run of stops after a common letter or digit;
    case is folded by the tokenizer.  So ids are looked up for stems (lower-cased, where that
    is surely all the tokenizer does) and for their stops.  Stems of letters alone are one pre-token each: many of them are encoded
    in one text and told apart by the tokens that end a word.
    """
    state = kept_state()
    if ("tokenizer", path) not in state:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        vocab = tok.get_vocab(with_added_tokens=True)
        ends = np.zeros(max(vocab.values()) + 1, bool)
        ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        state["tokenizer", path] = (tok, ends, {})
    tok, ends, cache = state["tokenizer", path]

    def alone(words: list[str]) -> None:
        for lo in range(0, len(words), ALONE):  # an encoding is far larger than its ids
            part = words[lo : lo + ALONE]
            for w, e in zip(part, tok.encode_batch_fast(part, add_special_tokens=False)):
                cache[w] = np.array(e.ids, "<u4").tobytes()

    def learn(words: list[str]) -> None:
        if len(cache) + len(words) > CACHE:
            cache.clear()
        letters = [w for w in words if w.isalpha()]
        alone([w for w in words if not w.isalpha()])
        for lo in range(0, len(letters), 64):
            part = letters[lo : lo + 64]
            ids = np.array(tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            at = np.nonzero(ends[ids])[0] + 1
            if len(at) != len(part) or at[-1] != len(ids):
                alone(part)
                continue
            raw, a = ids.tobytes(), 0
            for w, z in zip(part, (at * 4).tolist()):
                cache[w] = raw[a:z]
                a = z

    def lookup(words: list[str]) -> list[bytes]:
        out = [cache.get(w) for w in words]
        at = [i for i, x in enumerate(out) if x is None]
        for lo in range(0, len(at), CACHE):
            part = at[lo : lo + CACHE]
            learn([words[i] for i in part])
            for i in part:
                out[i] = cache[words[i]]
        return out

    def ids_of(words: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """Id strings, and for each word the two of them (stem, stops) that make it up."""
        stem = pc.utf8_rtrim(words, characters=".,;:!?")
        parted = pc.and_(pc.match_substring_regex(stem, WORD_END), pc.not_equal(stem, words))
        stem = pc.if_else(parted, stem, words)
        # other letters may compose with marks before the tokenizer folds them, so they are looked up as they are
        stem = pc.if_else(pc.match_substring_regex(stem, PLAIN), pc.utf8_lower(stem), stem).dictionary_encode()
        stops = pc.replace_substring_regex(words.filter(parted), r"^.*[\pL\pN]", "").dictionary_encode()
        at = np.nonzero(parted.to_numpy(zero_copy_only=False))[0]
        pool = lookup(stem.dictionary.to_pylist())
        unit = np.column_stack([stem.indices.to_numpy().astype(np.int64), np.full(len(words), len(pool), np.int64)])
        unit[at, 1] += 1 + stops.indices.to_numpy()
        return [*pool, b"", *lookup(stops.dictionary.to_pylist())], unit

    return ids_of


def _pieces(path: str, capacity: int, piece: int, end_id: int, with_ids: bool):
    def cut(ids_of, texts: pa.Array, key: list) -> pa.RecordBatch:
        off, words = split_words(texts)
        enc = words.dictionary_encode()
        del words
        pool, unit = ids_of(enc.dictionary)
        unit = unit[enc.indices.to_numpy(zero_copy_only=False)].ravel()
        del enc
        size = np.array([len(p) // 4 for p in pool], np.int64)
        at, n = (np.cumsum(size) - size)[unit], size[unit]
        del unit
        end = np.concatenate([[0], np.cumsum(n)])
        tokens = np.frombuffer(b"".join(pool), "<u4")[np.repeat(at - end[:-1], n) + np.arange(end[-1])]
        off = 2 * off
        rows: list[list] = [[], [], [], [], [], []]
        for d, k in enumerate(key):
            t = np.append(tokens[end[off[d]] : end[off[d + 1]]], np.array([end_id], "<u4")).astype("<u4")
            whole = len(t) // capacity * capacity
            for s in [*range(0, whole, capacity), *range(whole, len(t), piece)]:
                p = t[s : s + (capacity if s < whole else piece)]
                for col, v in zip(rows, (k, s, len(p), zlib.crc32(p.tobytes()), len(t), p if with_ids else None)):
                    col.append(v)
        cols = [pa.array(c, pa.int64()) for c in rows[:5]]
        names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
        if with_ids:
            cols, names = [*cols, pa.array(rows[5], pa.list_(pa.int32()))], [*names, "ids"]
        return pa.RecordBatch.from_arrays(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _encoder(path)
        for b in batches:
            texts, key = b.column("text"), b.column("id").to_pylist()
            for lo, hi in text_slices(texts):
                yield cut(ids_of, plain(texts.slice(lo, hi - lo)), key[lo:hi])  # what a slice needs is gone before the next

    return tidy(run)


def _place(capacity: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("uid", "ascending")])
        sizes, uid = t.column("length").to_pylist(), t.column("uid").to_pylist()
        seq, offset = [0] * len(sizes), [0] * len(sizes)
        for w in windows(sizes, capacity):
            name, at = min(uid[i] for i in w), 0
            for i in w:
                seq[i], offset[i] = name, at
                at += sizes[i]
        t = t.append_column("sequence_id", pa.array(seq, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
        return t.drop_columns(["uid", "grp"])

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, piece: int = PIECE, end_id: int = END_ID, with_ids: bool = False, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A null or empty text is the end id alone; a text of any length is cut into pieces.  Repeated rows and repeated or null ids are
    packed once for each row.  Tied lengths are placed in a fixed order.  Only the two named
    columns are read.  An empty table gives no rows.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    pieces = src.mapInArrow(_pieces(tokenizer, capacity, piece, end_id, with_ids), schema)
    pieces = materialize(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    short = pieces.where(F.col("length") < capacity)
    tokens, n = short.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    groups = max(1, round(tokens / (capacity * group_windows)), -(-n // GROUP_PIECES))
    short = short.withColumn("grp", F.pmod(F.xxhash64("uid"), F.lit(groups)))
    placed = short.groupBy("grp").applyInArrow(_place(capacity), schema + ", sequence_id long, offset long")
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("uid"), "offset": F.lit(0).cast("long")}).drop("uid")
    return placed.unionByName(full).withColumnRenamed("id", id_col)
