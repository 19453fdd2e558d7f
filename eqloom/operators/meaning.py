"""The sentence that says what a formula means: candidates, signals, one choice a formula."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eqloom import lexicon as L
from eqloom.functions import text as T
from eqloom.operators import documents as D

DEPTH, LEAST, MOST = 12, 0.15, 15
WEIGHTS = {"eq_num": 5, "definitional": 3, "gazetteer": 3, "context_window": 2, "para_adj": 2, "same_section": 1, "bm25_top1": 1, "badlen": -1}


def pool(chunks: DataFrame) -> DataFrame:
    """(id, chunk_ord, text, ...): the passages a paper is searched in, neighbourhoods before sentences."""
    own = chunks.where("chunk_type <> 'paragraph'")
    far = F.when(F.col("chunk_type") == "sentence", 1 << 20).otherwise(0)
    return own.withColumn("chunk_ord", F.col("chunk_ord") + far)


def query_text(number: Column, latex: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in L.MEANING_STOP])
    terms = F.filter(F.regexp_extract_all(F.lower(latex), F.lit("([a-z]+)"), 1), lambda t: ~F.array_contains(stop, t) & (F.length(t) > 1))
    return F.concat_ws(" ", F.lit("equation"), number, F.lit("eq"), number, F.array_join(terms, " "))


def asks(eqs: DataFrame) -> DataFrame:
    """(id, name, text): what is asked for each formula."""
    return eqs.select("id", F.col("eq_num").alias("name"), query_text(F.col("eq_num"), F.col("equation")).alias("text"))


def candidates(eqs: DataFrame, pieces: DataFrame, hits: DataFrame) -> DataFrame:
    """A row for each formula and distinct prose sentence: retrieved ones, then those after and before it.

    A formula without passages or context has no rows.  `pieces` is the pool of passages, `hits` (id, name, rank, chunk_ord, score) what was found for each formula.
    """
    hits = hits.where(F.col("rank") <= DEPTH).select("id", F.col("name").alias("eq_num"), "rank", "chunk_ord", "score")
    # a passage is cleaned and cut once, however many formulas it was found for
    met = pieces.join(hits.select("id", "chunk_ord").distinct(), ["id", "chunk_ord"], "left_semi")
    said = _prose(met.select("id", "chunk_ord", "chunk_id", "section_id", "para_id", "char_offset", "text"))
    found = hits.join(said, ["id", "chunk_ord"]).select("id", "eq_num", "rank", "chunk_id", "section_id", "para_id", "char_offset", "score", F.lit(False).alias("context"), "pos", "s", "cited", "cue", "named", "para")
    side = F.explode(F.array(F.struct(F.lit(DEPTH + 1).alias("rank"), F.col("after").alias("text")), F.struct(F.lit(DEPTH + 2).alias("rank"), F.col("before").alias("text")))).alias("x")
    own = eqs.select("id", "eq_num", side).select("id", "eq_num", "x.rank", F.lit("context_window").alias("chunk_id"), F.lit(None).cast("string").alias("section_id"), F.lit("").alias("para_id"), F.lit(0).alias("char_offset"), F.lit(0.0).alias("score"), F.lit(True).alias("context"), F.col("x.text").alias("text"))
    cut = found.unionByName(_prose(own).select(*found.columns))
    # a hash before its texts, so that texts are compared only where they are the same
    first = F.row_number().over(Window.partitionBy("_h", "id", "eq_num", "s").orderBy("rank", "pos"))
    return cut.withColumn("_h", F.xxhash64("id", "eq_num", "s")).withColumn("_o", first).where("_o = 1").drop("_o", "_h")


def _prose(passages: DataFrame) -> DataFrame:
    """Rows with pos and s for each prose sentence of the cleaned text, char_offset moved to its place."""
    cut = passages.withColumn("text", T.clean_context(F.col("text"))).withColumn("c", T.pieces(F.col("text"))).drop("text")
    # the pieces before a sentence keep their blanks; what is exploded is made once, whatever is filtered above
    one = lambda x, i: F.struct(i.alias("pos"), T.strip(x).alias("s"), F.length(F.array_join(F.slice("c", F.lit(1), i), "")).alias("local"))
    cut = cut.withColumn("x", F.explode(F.transform("c", one))).drop("c")
    cut = cut.withColumn("char_offset", F.col("char_offset") + F.col("x.local")).select("*", "x.pos", "x.s").drop("x")
    return with_cues(cut.where((F.length("s") > 10) & T.is_prose(F.col("s"))))


def with_cues(sentences: DataFrame) -> DataFrame:
    """sentences (s, para_id) with what they show by themselves: the numbers they cite, a cue of a definition, a known name, their place."""
    s = F.col("s")
    return sentences.withColumns({"cited": F.transform(F.regexp_extract_all(s, F.lit(L.BRACKETED), 1), F.lower), "cue": s.rlike(L.DEFINITION_CUE), "named": T.has_gazetteer_name(s), "para": D.paragraph(F.col("para_id"))})


def signals(cands: DataFrame, places: DataFrame) -> DataFrame:
    """Candidates with `signals` (names) and `points`."""
    at = places.select("id", "eq_num", F.col("section_id").alias("eq_section"), D.paragraph(F.col("para_id")).alias("eq_para"))
    c = (cands if "cited" in cands.columns else with_cues(cands)).join(at, ["id", "eq_num"], "left")
    s = F.col("s")
    cites = F.array_contains("cited", F.lower("eq_num"))
    section = F.when(F.col("context"), F.col("eq_section")).otherwise(F.col("section_id"))
    fired = {
        "eq_num": cites & (F.length(s) > 30) & ~s.startswith("("),
        "definitional": F.col("cue"),
        "gazetteer": F.col("named"),
        "context_window": F.col("context"),
        "para_adj": ~F.col("context") & D.next_numbers(F.col("eq_para"), F.col("para")),
        "same_section": (F.col("eq_section") != "") & (section == F.col("eq_section")),
        "bm25_top1": F.col("rank") == 1,
        "badlen": (F.length(s) < 30) | (F.length(s) > 400),
    }
    c = c.withColumn("signals", F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in fired.items()])))
    points = reduce(Column.__add__, [F.when(F.array_contains("signals", k), w).otherwise(0) for k, w in WEIGHTS.items()])
    return c.withColumn("points", points)


def choose(scored: DataFrame, eqs: DataFrame) -> DataFrame:
    """(id, eq_num, meaning, points, bm25, chunk_id, char_start, char_end, signals): the choice of each formula.

    In a paper, formulas choose in document order, each its best sentence that none before it
    took; sentences below the threshold are no candidates.  A formula without one has an empty
    meaning.  The order of choice needs one row a paper: at most seven formulas and the
    sentences of their passages.
    """
    fields = ["p", "b", "rank", "pos", "s", "chunk_id", "char_offset", "signals"]
    # the others of its paper take a sentence each, so a formula's best by the number of all hold its choice
    turns = eqs.select("id", "eq_num", "eq_ord", F.count(F.lit(1)).over(Window.partitionBy("id")).alias("_n"))
    good = scored.where(F.col("points") / MOST >= LEAST).withColumns({"p": -F.col("points"), "b": -F.round("score", 6)}).select("id", "eq_num", *fields)
    best = good.withColumn("_o", F.row_number().over(Window.partitionBy("id", "eq_num").orderBy(*fields[:7]))).join(turns, ["id", "eq_num"]).where(F.col("_o") <= F.col("_n"))
    lists = best.groupBy("id", "eq_num").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("c"))
    turn = turns.join(lists, ["id", "eq_num"], "left")
    paper = turn.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("eq_ord", "eq_num", "c"))).alias("e"))
    item = "struct<p:int,b:double,rank:int,pos:int,s:string,chunk_id:string,char_offset:int,signals:array<string>>"
    taken = F.array().cast(f"array<struct<eq_num:string,c:{item}>>")

    def step(acc, e):
        free = F.filter(e["c"], lambda x: ~F.exists(acc, lambda t: F.coalesce(t["c"]["s"] == x["s"], F.lit(False))))
        pick = F.struct(e["eq_num"].alias("eq_num"), F.try_element_at(free, F.lit(1)).cast(item).alias("c"))
        return F.concat(acc, F.array(pick))

    out = paper.select("id", F.explode(F.aggregate("e", taken, step)).alias("x")).select("id", "x.eq_num", "x.c.*")
    return out.select("id", "eq_num", F.coalesce("s", F.lit("")).alias("meaning"), (-F.col("p")).alias("points"), (-F.col("b")).alias("bm25"), "chunk_id", F.col("char_offset").alias("char_start"), (F.col("char_offset") + F.length("s")).alias("char_end"), "signals")


def retrieval_log(eqs: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, eq_num, query, hits): what was asked for each formula, and how many passages came."""
    n = hits.where(F.col("rank") <= DEPTH).groupBy("id", "name").agg(F.count(F.lit(1)).alias("hits"))
    asked = asks(eqs).join(n, ["id", "name"], "left")
    return asked.select("id", F.col("name").alias("eq_num"), F.col("text").alias("query"), F.coalesce("hits", F.lit(0)).alias("hits"))


def idf(texts: DataFrame, col: str = "text") -> DataFrame:
    """(term, idf) over texts, repeated ones counted each: ln((n + 1) / (df + 1)) + 1."""
    n = texts.agg(F.count(F.lit(1)).alias("n"))  # one row
    df = texts.select(F.explode(F.array_distinct(words(F.col(col)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def words(c: Column) -> Column:
    """Lower-cased letter runs of two or more without stop words."""
    stop = "|".join(L.MEANING_STOP)
    return F.regexp_extract_all(F.lower(c), F.lit(rf"(?<![a-z])(?!(?:{stop})(?![a-z]))[a-z]{{2,}}"), 0)


def mean_idf(sentences: DataFrame, idfs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score) of sentences (keys, s): the mean idf of their words; those without words are no rows."""
    t = sentences.select(*keys, F.explode(words(F.col("s"))).alias("term"))
    return t.join(idfs, "term", "left").groupBy(*keys).agg(F.avg(F.coalesce("idf", F.lit(0.0))).alias("score"))


def cascade(eqs: DataFrame) -> DataFrame:
    """(id, eq_num, meaning, strategy, score): the earlier rule, for each formula by itself.

    Of the sentences of its own context: the first that cites it, else the first with a known
    name, else the one whose words are rarest over all contexts.  An empty meaning has no strategy.
    """
    sides = eqs.select("id", "eq_num", F.explode(F.array("before", "after")).alias("text"))
    both = F.transform(F.array("before", "after"), lambda x: F.transform(T.sentences(T.strip(x)), T.strip))
    kept = F.array_distinct(F.filter(F.flatten(both), lambda x: F.length(x) > 10))
    s = eqs.select("id", "eq_num", F.posexplode(kept).alias("i", "s"))
    ranked = mean_idf(s, idf(sides), ["id", "eq_num", "i"]).select("id", "eq_num", "i", F.round("score", 6).alias("score"))
    s = s.join(ranked, ["id", "eq_num", "i"], "left")
    cited = F.array_contains(F.transform(F.regexp_extract_all("s", F.lit(L.BRACKETED), 1), F.lower), F.lower("eq_num"))
    step = F.when(cited, 1).when(T.has_gazetteer_name(F.col("s")), 2).when(F.col("score").isNotNull(), 3)
    order = F.struct(step.alias("step"), F.when(step == 3, -F.col("score")).otherwise(0.0).alias("by"), F.col("i").alias("i"), F.col("s").alias("s"), F.col("score").alias("score"))
    best = s.where(step.isNotNull()).groupBy("id", "eq_num").agg(F.min(order).alias("b"))
    out = eqs.select("id", "eq_num").join(best, ["id", "eq_num"], "left")
    name = F.element_at(F.array(F.lit("citation_match"), F.lit("gazetteer_match"), F.lit("tfidf_rank")), F.col("b.step"))
    return out.select("id", "eq_num", F.coalesce("b.s", F.lit("")).alias("meaning"), F.when(F.col("b").isNotNull(), name).alias("strategy"), F.when(F.col("b.step") == 3, F.col("b.score")).alias("score"))
