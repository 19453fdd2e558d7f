"""Graded relations between the formulas of a paper, from four signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eqloom import lexicon as L
from eqloom.functions import text as T
from eqloom.operators import documents as D

DEPTH, JACCARD, COSINE, WIDTH = 3, 0.30, 0.60, 200


def pairs(eqs: DataFrame) -> DataFrame:
    """(id, a, b): every ordered pair of a paper's formulas, at most 42 of them."""
    return eqs.select("id", F.col("eq_num").alias("a")).join(eqs.select("id", F.col("eq_num").alias("b")), "id").where("a <> b")


def jaccard(a: Column, b: Column) -> Column:
    """Common share of two symbol arrays; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def citing(number: Column) -> Column:
    """Pattern of the sentence around a citation of a number; it starts only where a sentence does."""
    safe = F.regexp_replace(number, r"([^A-Za-z0-9])", r"\\$1")
    return F.concat(F.lit("(?isU)(?:(?<=[.!?])|^)([^.!?]*?" + L.CITED_BEFORE), safe, F.lit(L.CITED_AFTER + "[^.!?]*[.!?]?)"))


def bracketed(context: Column) -> Column:
    """Numbers in brackets, lower-cased: what a text can cite at all."""
    return F.array_distinct(F.transform(F.regexp_extract_all(context, F.lit(L.BRACKETED), 1), F.lower))


def citation_sentence(number: Column, context: Column) -> Column:
    """The sentence of the first citation; null if it is short or begins with a bracket."""
    s = T.strip(F.call_function("regexp_extract", context, citing(number), F.lit(1)))
    return F.when((F.length(s) > 20) & ~s.startswith("("), s)


def cue_sentence(number: Column, context: Column) -> Column:
    """The first sentence that cites the number and holds a cue of a derivation."""
    every = F.transform(F.regexp_extract_all(context, citing(number), 1), T.strip)
    return F.try_element_at(F.filter(every, T.has_cue), F.lit(1))


def cosines(texts: DataFrame) -> DataFrame:
    """(id, a, b, cosine) of TF-IDF vectors of (id, eq_num, text); counts are those of the paper.

    Texts without words (null ones too) count, but have no rows.
    """
    stop = F.array(*[F.lit(w) for w in L.PAIR_STOP])
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1), lambda t: ~F.array_contains(stop, t) & (F.length(t) > 1))
    n = F.count(F.lit(1)).over(Window.partitionBy("id"))
    tf = texts.withColumn("n", n).select("id", "eq_num", "n", F.explode(words).alias("term")).groupBy("id", "eq_num", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("n").alias("n"))
    df = F.count(F.lit(1)).over(Window.partitionBy("id", "term"))
    w = tf.withColumn("w", F.col("tf") * (F.log((F.col("n") + 1) / (df + 1)) + 1))
    w = w.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id", "eq_num")))).select("id", "eq_num", "term", "w")
    a, b = w.withColumnsRenamed({"eq_num": "a", "w": "wa"}), w.withColumnsRenamed({"eq_num": "b", "w": "wb"})
    return a.join(b, ["id", "term"]).where("a <> b").groupBy("id", "a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))


def clean(c: Column) -> Column:
    for p in (L.CONTEXT_ARTIFACTS, L.RAW_LATEX, r"[{}]"):
        c = F.regexp_replace(c, "(?U)" + p, "")
    return F.substring(T.strip(F.regexp_replace(c, " {2,}", " ")), 1, WIDTH)


def asks(eqs: DataFrame) -> DataFrame:
    """(id, name, text): what is asked for the passages around each formula."""
    return eqs.select("id", F.col("eq_num").alias("name"), F.concat(F.lit("equation "), "eq_num", F.lit(" eq "), "eq_num", F.lit(" ("), "eq_num", F.lit(")")).alias("text"))


def graded(eqs: DataFrame, places: DataFrame, pieces: DataFrame, hits: DataFrame, refs: DataFrame, meanings: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, a, b, grade, description, jaccard, cosine, signals) of every ordered pair.

    strong: a cross reference to b beside a, a citation of b in a's own context, or a sentence
    that cites b with a cue of a derivation; potential: shared symbols or similar texts.
    A paper of one formula has no rows; an empty text is like no other, and no symbols are shared with none.
    """
    local = T.strip(F.concat_ws(" ", "before", "after"))
    hits = hits.where(F.col("rank") <= DEPTH).select("id", F.col("name").alias("qid"), "rank", "chunk_ord").join(pieces.select("id", "chunk_ord", "text"), ["id", "chunk_ord"])
    wide = hits.groupBy("id", F.col("qid").alias("eq_num")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), " ").alias("found"))
    own = symbols.where("reject_reason IS NULL").groupBy("id", "eq_num").agg(F.sort_array(F.collect_set("sym")).alias("syms"))
    side = eqs.select("id", "eq_num", local.alias("local")).join(meanings.select("id", "eq_num", "meaning"), ["id", "eq_num"], "left").join(places, ["id", "eq_num"], "left").join(own, ["id", "eq_num"], "left").join(wide, ["id", "eq_num"], "left")
    side = side.withColumn("syms", F.coalesce("syms", F.array().cast("array<string>")))
    text = F.coalesce(F.nullif(T.strip(F.col("meaning")), F.lit("")), F.nullif(F.substring("local", 1, 500), F.lit("")), F.lit(" "))
    alike = cosines(side.select("id", "eq_num", text.alias("text")))

    a = side.select("id", F.col("eq_num").alias("a"), "local", F.coalesce("section_id", F.lit("")).alias("sec"), F.coalesce("para_id", F.lit("")).alias("para"), T.strip(F.concat_ws(" ", "local", "found")).alias("wide"), F.col("syms").alias("sa"))
    a = a.withColumns({"_near": bracketed(F.col("local")), "_far": bracketed(F.col("wide"))})
    p = pairs(eqs).join(a, ["id", "a"]).join(side.select("id", F.col("eq_num").alias("b"), F.col("syms").alias("sb")), ["id", "b"])
    # the references to b beside a, of which the first one counts, even with an empty sentence
    beside = pairs(eqs).join(a.select("id", "a", "sec", "para"), ["id", "a"]).join(refs.withColumnRenamed("to_eq_num", "b"), ["id", "b"])
    home = F.regexp_extract("from_para_id", L.SECTION_OF, 1)
    match = F.when(F.col("para") != "", (F.col("from_para_id") == F.col("para")) | D.adjacent(F.col("para"), F.col("from_para_id"))).otherwise((F.col("sec") == "") | (home == F.col("sec")))
    graph = beside.where(match).groupBy("id", "a", "b").agg(F.min_by("sentence", "ord").alias("graph"))
    p = p.join(graph, ["id", "a", "b"], "left").join(alike, ["id", "a", "b"], "left")

    p = p.withColumns({"graph": F.nullif("graph", F.lit("")), "cite": F.when(F.array_contains("_near", F.lower("b")), citation_sentence(F.col("b"), F.col("local"))), "cue": F.when(F.array_contains("_far", F.lower("b")), cue_sentence(F.col("b"), F.col("wide")))})
    strong = F.coalesce("graph", "cite", "cue")
    shared = F.sort_array(F.array_intersect("sa", "sb"))
    p = p.withColumns({"_strong": strong, "_shared": shared, "_j": jaccard(F.col("sa"), F.col("sb")), "_c": F.coalesce(F.round("cosine", 6), F.lit(0.0))})
    weak = F.col("_strong").isNull()
    by_symbols, by_text = weak & (F.col("_j") >= JACCARD), weak & (F.col("_c") >= COSINE)
    named = F.array_compact(F.array(F.when(F.col("graph").isNotNull(), F.lit("crossref+graph")).when(F.col("cite").isNotNull(), F.lit("crossref")), F.when(F.col("cue").isNotNull(), F.lit("deriv_cue")), F.when(by_symbols, F.format_string("jaccard=%.2f", "_j")), F.when(by_text, F.format_string("tfidf=%.2f", "_c"))))
    said = F.when(~weak, clean(F.col("_strong"))).when(by_symbols, F.concat(F.lit("shares symbols: "), F.array_join("_shared", ", "))).when(by_text, F.format_string("semantically similar (cosine=%.2f)", "_c")).otherwise("")
    grade = F.when(~weak, "strong").when(by_symbols | by_text, "potential").otherwise("none")
    zero = lambda c: F.when(weak, F.col(c)).otherwise(0.0)
    return p.select("id", "a", "b", grade.alias("grade"), said.alias("description"), zero("_j").alias("jaccard"), zero("_c").alias("cosine"), named.alias("signals"))


def cites(eqs: DataFrame) -> DataFrame:
    """(id, a, b, place): the formulas of the paper that a's own context cites, in order, each once."""
    cited = F.array_distinct(T.any_cited(F.concat("before", F.lit(" "), "after")))
    c = eqs.select("id", F.col("eq_num").alias("a"), F.posexplode(cited).alias("place", "b")).where("a <> b")
    return c.join(eqs.select("id", F.col("eq_num").alias("b")), ["id", "b"], "left_semi").select("id", "a", "b", "place")


def shared_symbols(symbols: DataFrame) -> DataFrame:
    """(id, a, b, shared): formulas with a symbol in common."""
    a = symbols.select("id", F.col("eq_num").alias("a"), "sym")
    return a.join(a.withColumnRenamed("a", "b"), ["id", "sym"]).where("a <> b").groupBy("id", "a", "b").agg(F.sort_array(F.collect_set("sym")).alias("shared"))
