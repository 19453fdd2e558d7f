"""Line deduplication by a deletion-neighbourhood join, edit bound 1.

Lines are compared trimmed and lower-cased.  A line of `exact_chars` or more goes if an earlier
line (by document id, then line number) is equal, one of `min_chars` or more also if an earlier
one of that length is one edit away; blank lines stay.  op6 and the pipeline remove the later exact
copies of every non-blank line; a line under 24 characters says too little to go for a likeness.

1. Equal lines meet by hash; a map-side minimum keeps the earliest place of each.
2. Coarse variants: a line without one of three blocks, for both lengths that the shorter
   of a pair may have.  Two lines within one edit share the variant that leaves out the
   block with the edit, so only lines whose coarse variant occurs for another line go on.
3. Fine variants, inside that block: every deletion of one character.  Lines of one length
   join on (variant, place), a line and a longer one on (whole block, variant).  Everything
   in such a group is one edit from the group's earliest line, so a group of any size is
   settled by a minimum: no pairs are made.
4. Each found pair (line, earliest partner) is verified by its edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eqloom.llm.common import bitmap, discard, join_counted, materialize, plain, text_slices, tidy, unused

MIN_CHARS, BLOCKS, BITS = 24, 3, 23


def normal_lines(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lines of each text (offsets and flat array), trimmed and lower-cased."""
    lists = pc.split_pattern(texts, "\n")
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(n)]), pc.utf8_lower(pc.ascii_trim_whitespace(lists.flatten()))


def _long(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def coarse(line: str, blocks: int) -> list[int]:
    """Keys of the line without one block, as the shorter and as the longer of a pair."""
    from xxhash import xxh3_64_intdigest as h

    out, n = [], len(line)
    for m in (n, n - 1):
        for b in range(blocks):
            s, e = b * m // blocks, (b + 1) * m // blocks
            out.append(h(f"{line[:s]}\0{line[n - (m - e) :]}", m * blocks + b))
    return out


def fine(line: str, at: int, blocks: int, key: int) -> list[tuple[int, int]]:
    """(join key, role) of each deletion in the block left out by coarse key number `at`.

    Role 0: lines of one length; 1: the shorter line's whole block; 2: a longer line's deletions.
    """
    from xxhash import xxh3_64_intdigest as h

    n = len(line)
    m, b = n - at // blocks, at % blocks
    s, e = b * m // blocks, (b + 1) * m // blocks
    c = line[s : n - (m - e)]
    key &= 0xFFFFFFFFFFFFFFFF
    if m == n:
        return [(h(f"{key}\0{i}\0{c[:i]}{c[i + 1 :]}", 1), 0) for i in range(len(c))] + [(h(f"{key}\0{c}", 2), 1)]
    return [(k, 2) for k in {h(f"{key}\0{c[:i]}{c[i + 1 :]}", 2) for i in range(len(c))}]


def _lines(min_chars: int, exact_chars: int, blocks: int):
    from xxhash import xxh3_64_intdigest as h

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = plain(b.column("text"))
            for lo, hi in text_slices(texts):
                off, flat = normal_lines(texts.slice(lo, hi - lo))
                doc = np.repeat(np.arange(lo, hi), np.diff(off))
                number = np.arange(len(doc)) - np.repeat(off[:-1], np.diff(off))
                size = pc.utf8_length(flat).to_numpy(zero_copy_only=False)
                pick = size >= max(1, exact_chars)
                doc, number, near = doc[pick], number[pick], size[pick] >= min_chars
                enc = flat.filter(pa.array(pick)).dictionary_encode()
                idx, uniq = enc.indices.to_numpy(zero_copy_only=False), enc.dictionary.to_pylist()
                hs = np.fromiter((h(u) for u in uniq), np.uint64, len(uniq))
                keys = np.array([coarse(u, blocks) if len(u) >= min_chars else [0] * 2 * blocks for u in uniq], np.uint64).reshape(len(uniq), 2 * blocks)
                # a line's keys follow from its hash, so one place of it in a slice carries them
                once = np.zeros(len(idx), bool)
                once[np.unique(idx, return_index=True)[1]] = True
                once &= near
                ends = np.concatenate([[0], np.cumsum(once * 2 * blocks)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[idx[once]].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(doc)), b.column("fp").take(pa.array(doc)), pa.array(number, pa.int64()), pa.array(hs[idx].view(np.int64)), lists], ["id", "fp", "line", "h", "keys"])

    return tidy(run)


def _texts(held: np.ndarray, bits: int):
    from xxhash import xxh3_64_intdigest as h

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = plain(b.column("text"))
            for lo, hi in text_slices(texts):
                uniq = normal_lines(texts.slice(lo, hi - lo))[1].unique().to_pylist()
                hs = np.fromiter((h(u) for u in uniq), np.uint64, len(uniq))
                x = (hs & np.uint64((1 << bits) - 1)).astype(np.int64)
                hit = np.nonzero((held[x >> 3] >> (x & 7).astype(np.uint8)) & 1)[0]
                yield pa.RecordBatch.from_arrays([pa.array(hs[hit].view(np.int64)), pa.array([uniq[i] for i in hit], pa.string())], ["h", "norm"])

    return tidy(run)


def _variants(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, at, norm = (b.column(c).to_pylist() for c in ("key", "at", "norm"))
            for lo in range(0, b.num_rows, 500):
                found = [fine(norm[i], at[i], blocks, key[i]) for i in range(lo, min(lo + 500, b.num_rows))]
                src = pa.array(np.repeat(np.arange(lo, lo + len(found)), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays([_long([k for f in found for k, _ in f]), pa.array([r for f in found for _, r in f], pa.int32()), b.column("h").take(src), b.column("pos").take(src)], ["v", "role", "h", "pos"])

    return run


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Line numbers to remove as a mask over the lines up to the last of them."""
    for b in batches:
        lists = b.column("lines")
        off, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()
        most = np.maximum.reduceat(flat, off[:-1]) + 1 if len(lists) else np.zeros(0, np.int64)  # no list is empty
        ends = np.concatenate([[0], np.cumsum(most)])
        mask = np.zeros(ends[-1], bool)
        mask[flat + np.repeat(ends[:-1], np.diff(off))] = True
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("fp"), pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(mask)).cast(pa.list_(pa.bool_())), pa.array(np.diff(off).astype(np.int64))], ["id", "fp", "gone", "n"])


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, blocks: int = BLOCKS, exact_chars: int | None = None) -> DataFrame:
    """(id, fp, gone, n): a mask of the lines to remove, and their number, for each document that has any.

    fp is xxhash64 of the text, so rows that share an id but not a text stay apart; rows that
    repeat both stand at the same places and lose the same lines.  A null id is earliest.  Without `exact_chars`, it is `min_chars`.
    """
    exact_chars = min_chars if exact_chars is None else exact_chars
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("fp"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    lines = materialize(src.mapInArrow(_lines(min_chars, exact_chars, blocks), "id long, fp long, line long, h long, keys array<long>"), "lines")
    pos = F.struct("id", "line", "fp")
    firsts = materialize(lines.groupBy("h").agg(F.min(pos).alias("pos"), F.count(F.lit(1)).alias("n")), "firsts")
    keyed = lines.select("h", F.posexplode("keys").alias("at", "key"))
    shared = keyed.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("key")
    cand = materialize(keyed.join(shared, "key").distinct(), "cand")
    norm = src.select("text").mapInArrow(_texts(bitmap(cand.select(F.col("h").alias("key")), BITS), BITS), "h long, norm string").join(cand.select("h").distinct(), "h", "left_semi").dropDuplicates(["h"])
    norm = materialize(norm, "norm")
    rows = cand.join(norm, "h").join(firsts.select("h", "pos"), "h").select("key", "at", "h", "pos", "norm")
    schema = "v long, role int, h long, pos struct<id: bigint, line: bigint, fp: bigint>"
    var = materialize(rows.mapInArrow(_variants(blocks), schema), "variants")
    at = F.struct("pos", "h")
    group = (
        var.groupBy("v")
        .agg(F.min("h").alias("a"), F.max("h").alias("b"), F.min(F.when(F.col("role") == 0, at)).alias("same"), F.min(F.when(F.col("role") == 1, at)).alias("short"), F.min(F.when(F.col("role") == 2, at)).alias("long"))
        .where("a <> b")
    )
    other = F.when(F.col("role") == 0, F.col("same")).when(F.col("role") == 1, F.col("long")).otherwise(F.col("short"))
    pairs = var.join(group, "v").withColumn("other", other).where(F.col("other.pos") < F.col("pos")).groupBy("h").agg(F.min("other").alias("o"))
    pairs = pairs.select("h", F.col("o.h").alias("h2"))
    near = pairs.join(norm, "h").join(norm.select(F.col("h").alias("h2"), F.col("norm").alias("norm2")), "h2")
    near = near.where(F.levenshtein("norm", "norm2", 1) >= 0).select("h", F.lit(True).alias("near"))
    marked = materialize(firsts.join(near, "h", "left").where("n > 1 or near"), "marked")
    gone = join_counted(lines.drop("keys"), marked, ["h"]).where(F.coalesce("near", F.lit(False)) | (pos != F.col("pos")))
    out = materialize(gone.groupBy("id", "fp").agg(F.collect_set("line").alias("lines")).mapInArrow(_masks, "id long, fp long, gone array<boolean>, n long"), "gone")
    discard(lines, firsts, cand, norm, var, marked)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs with the repeated lines cut from the text, and n_lines and n_removed.

    A null text stays null with no lines; an empty text is one empty line.  A text may become
    empty.  Texts and lines may be of any length: lines are cut by a mask, in one pass over them.
    All other columns are passed through (a column that is itself called n_lines or
    n_removed is replaced).  An empty table gives an empty table.
    """
    i, f, gone, n = unused([*docs.columns, "n_lines", "n_removed"], "_id", "_fp", "_gone", "_n")
    few = repeated_lines(docs, id_col, text_col, **how).select(F.col("id").alias(i), F.col("fp").alias(f), F.col("gone").alias(gone), F.col("n").alias(n))
    own_id, own_fp = F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))
    out = docs.drop("n_lines", "n_removed") if {"n_lines", "n_removed"} & {c.lower() for c in docs.columns} else docs
    out = out.join(few, own_id.eqNullSafe(F.col(i)) & (own_fp == F.col(f)), "left").drop(i, f)
    keep = F.filter(F.split(F.col(text_col), "\n", -1), lambda x, at: ~F.coalesce(F.get(F.col(gone), at), F.lit(False)))
    lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(F.split(F.col(text_col), "\n", -1))).cast("long")
    left = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(keep, "\n"))
    return out.withColumns({"n_lines": lines, "n_removed": F.coalesce(F.col(n), F.lit(0)).cast("long"), text_col: left}).drop(gone, n)
