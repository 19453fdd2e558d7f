"""Symbols of a formula and the phrases that define them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eqloom import lexicon as L
from eqloom.functions import text as T

DEPTH, WORDS = 5, 15


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv])


def keys_of_identifiers(mi: Column) -> Column:
    """Distinct symbols of <mi> names in order: Greek letters by name, no commands, no numbers."""
    greek = _map({c: n for n, chars in L.GREEK.items() for c in chars})
    skip = F.array(*[F.lit(c) for c in sorted({c.lower() for c in L.SKIP_COMMANDS})])
    exact = F.array(*[F.lit(c) for c in L.SKIP_COMMANDS])
    name = lambda x: F.coalesce(F.try_element_at(greek, x), F.regexp_replace(x, r"^\\", ""))
    keep = lambda b: ~F.array_contains(exact, b) & ((F.length(b) == 1) | ~F.array_contains(skip, F.lower(b))) & b.rlike(r"^(?:\p{L}+|[A-Za-z][A-Za-z0-9]*)$")
    parts = F.transform(mi, lambda x: F.struct(name(F.regexp_extract(x, r"^([^_]*)", 1)).alias("b"), name(F.regexp_extract(x, r"_(.*)$", 1)).alias("s")))
    return F.array_distinct(F.transform(F.filter(parts, lambda p: keep(p["b"])), lambda p: F.concat_ws("_", p["b"], F.nullif(p["s"], F.lit("")))))


def forms(sym: Column) -> Column:
    """How prose writes a symbol: Greek letters also by their characters."""
    chars = F.try_element_at(_map(L.GREEK), sym)
    return F.concat(F.filter(F.split(F.coalesce(chars, F.lit("")), ""), lambda x: x != ""), F.array(sym))


def of_formulas(eqs: DataFrame) -> DataFrame:
    """(id, eq_num, ord, sym, all): identifiers of the MathML, else symbols of the LaTeX."""
    all_ = F.when(F.col("mi").isNotNull(), keys_of_identifiers(F.col("mi"))).otherwise(T.latex_symbols(F.col("equation")))
    return eqs.select("id", "eq_num", "before", "after", all_.alias("all")).select("id", "eq_num", "before", "after", "all", F.posexplode("all").alias("ord", "sym"))


def _as(name: str, confidence: str):
    return lambda x: F.struct(x.alias("definition"), F.lit(name).alias("pattern"), F.lit(confidence).alias("confidence"))


def find(sym: Column, context: Column) -> Column:
    """struct(definition, pattern, confidence) of the first phrase of 1 to 15 words, else null.

    The patterns are columns, since each symbol has its own; they are tried only where the symbol
    stands alone in the text, and those that begin with a word only where it is there.
    """
    low = F.lower(context)
    safe = lambda s: F.regexp_replace(s, r"([^\p{L}\p{N}_])", r"\\$1")
    own = F.array_join(F.transform(forms(sym), safe), "|")
    there = F.exists(forms(sym), lambda f: F.contains(low, F.lower(f))) & F.call_function("rlike", context, F.concat(F.lit(r"(?iU)(?:\b|\$\\?)(?:"), own, F.lit(r")(?:\b|[\s,$]|$)")))
    shapes = F.concat(own, F.lit(r"|\$\\?"), safe(sym), F.lit(r"\$"))
    out = []
    for name, template, confidence in L.DEFINITIONS:
        left, right = template.split("{SYM}")
        pattern = F.concat(F.lit("(?isU)" + left + "(?:"), shapes, F.lit(")" + right))
        got = F.array(T.strip(F.call_function("regexp_extract", context, pattern, F.lit(1))))  # an array, so that it is looked for once
        short = F.filter(got, lambda g: (g != "") & (F.size(F.split(g, r"(?U)\s+")) <= WORDS))
        found = F.try_element_at(F.transform(short, _as(name, confidence)), F.lit(1))
        word = re.match(r"\\b([a-z]+)", left)
        out.append(F.when(F.contains(low, F.lit(word[1])), found) if word else found)
    return F.when(there, F.coalesce(*out))


def earlier(eqs: DataFrame) -> DataFrame:
    """(id, eq_num, ord, sym, definition, pattern): the earlier rule, symbols of the LaTeX in the formula's own context.

    Phrases of any confidence are taken and none is rejected.
    """
    syms = eqs.select("id", "eq_num", T.strip(F.concat_ws(" ", "before", "after")).alias("c"), F.posexplode(T.latex_symbols(F.col("equation"))).alias("ord", "sym"))
    found = syms.sortWithinPartitions("sym").withColumn("f", F.explode(F.array_compact(F.array(find(F.col("sym"), F.col("c"))))))
    return found.select("id", "eq_num", "ord", "sym", "f.definition", "f.pattern")


def asks(eqs: DataFrame) -> DataFrame:
    """(id, name, text): what is asked for each symbol of a paper, its first three forms."""
    sym = of_formulas(eqs).select("id", F.col("sym").alias("name")).distinct()
    return sym.select("id", "name", F.array_join(F.slice(forms(F.col("name")), 1, 3), " ").alias("text"))


def definitions(eqs: DataFrame, pieces: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, eq_num, ord, sym, definition, pattern, confidence, reject_reason, chunk_id) of each symbol with a phrase.

    A phrase is looked for in the five best passages for the symbol (`hits`: id, name, rank, chunk_ord), then in the formula's own
    context; rows with a reject_reason are for the audit, the others are results.
    """
    syms = of_formulas(eqs)
    hits = hits.where(F.col("rank") <= DEPTH).select("id", F.col("name").alias("qid"), "rank", "chunk_ord").join(pieces.select("id", "chunk_ord", "chunk_id", "text"), ["id", "chunk_ord"])
    top = F.array_sort(F.collect_list(F.struct("rank", "text", "chunk_id")))
    near = hits.groupBy("id", F.col("qid").alias("sym")).agg(top.alias("h"))
    s = syms.join(near, ["id", "sym"], "left")
    context = T.strip(F.concat_ws(" ", F.array_join(F.col("h")["text"], " "), T.strip(F.concat_ws(" ", "before", "after"))))
    # an explosion, so that neither text nor phrase is made again for a filter; beside its likes a symbol's patterns are compiled once
    s = s.withColumn("context", context).sortWithinPartitions("sym")
    s = s.withColumn("found", F.explode(F.array_compact(F.array(find(F.col("sym"), F.col("context"))))))
    others = F.array_remove(F.col("all"), F.col("sym"))
    reason = F.when(F.col("found.confidence") == "low", "low_confidence").otherwise(T.reject_reason(F.col("found.definition"), F.col("sym"), others))
    return s.select("id", "eq_num", "ord", "sym", "found.*", reason.alias("reject_reason"), F.coalesce(F.try_element_at(F.col("h")["chunk_id"], F.lit(1)), F.lit("context_window")).alias("chunk_id"))


def new_keys(base: DataFrame, more: DataFrame) -> DataFrame:
    """Symbols that only the second way of looking found."""
    return more.select("id", "eq_num", "sym").join(base.select("id", "eq_num", "sym"), ["id", "eq_num", "sym"], "left_anti")
