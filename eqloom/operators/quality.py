"""Quality figures of an analysis: counts, coverage, validity, distributions, formats, reports.

Tables are those of knowledge.analyse by name, entries those of knowledge.read_document.
Shares are null where there is nothing to share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eqloom import lexicon as L

FULL = 7


def share(part: Column, whole: Column) -> Column:
    return F.round(part / F.nullif(whole, F.lit(0)), 6)


def per_paper(papers: DataFrame, eqs: DataFrame, full: int = FULL) -> DataFrame:
    """(id, n, status, eq_nums, methods, sources) of every paper: EMPTY, UNDER or FULL, lists joined by a comma."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    nums = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("eq_ord", "eq_num"))), lambda x: x["eq_num"]), ", ")
    e = eqs.groupBy("id").agg(F.count(F.lit(1)).alias("n"), nums.alias("eq_nums"), joined("latex_method").alias("methods"), joined("source").alias("sources"))
    n = F.coalesce("n", F.lit(0))
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("eq_nums", "methods", "sources")]
    return papers.select("id").join(e, "id", "left").select("id", n.alias("n"), F.when(n == 0, "EMPTY").when(n < full, "UNDER").otherwise("FULL").alias("status"), *text)


def histogram(papers: DataFrame, eqs: DataFrame) -> DataFrame:
    """(n, papers, share): papers by their number of formulas, those without any included."""
    h = per_paper(papers, eqs).groupBy("n").agg(F.count(F.lit(1)).alias("papers"))
    return _of_total(h, "papers")


def _of_total(counts: DataFrame, n: str) -> DataFrame:
    total = counts.agg(F.sum(n).alias("_t"))  # one row
    return counts.crossJoin(F.broadcast(total)).withColumn("share", share(F.col(n), F.col("_t"))).drop("_t")


def coverage(t: dict[str, DataFrame]) -> DataFrame:
    """(metric, n, total, share), a row each: what is empty, related, garbage or noise."""
    metric = lambda name, n, total: F.struct(F.lit(name).alias("metric"), n.cast("long").alias("n"), total.cast("long").alias("total"))
    one, eq = F.lit(1), ["id", "eq_num"]
    rows = lambda agg: agg.select(F.explode("x").alias("x")).select("x.*")
    t["relations"]  # first, since the others come with them
    p = per_paper(t["papers"], t["equations"])
    papers = rows(p.agg(F.array(metric("papers_empty", F.count_if(F.col("n") == 0), F.count(one)), metric("equations", F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)))).alias("x")))
    good = t["symbols"].where("reject_reason IS NULL")
    own = good.groupBy(*eq).agg(F.count(one).alias("syms"))
    rel = t["relations"].groupBy("id", F.col("a").alias("eq_num")).agg(F.count_if(F.col("grade") != "none").alias("related"))
    e = t["equations"].select(*eq).join(t["meanings"].select(*eq, "meaning"), eq, "left").join(own, eq, "left").join(rel, eq, "left")
    said = F.coalesce("meaning", F.lit("")) != ""
    every = rows(e.agg(F.array(
        metric("meaning_empty", F.count_if(~said), F.count(one)),
        metric("symbols_empty", F.count_if(F.col("syms").isNull()), F.count(one)),
        metric("relations_all_none", F.count_if(F.coalesce("related", F.lit(0)) == 0), F.count(one)),
        metric("meaning_noise", F.count_if(said & F.col("meaning").rlike("(?U)" + L.NOISE)), F.count_if(said)),
    ).alias("x")))
    pairs = rows(t["relations"].agg(F.array(metric("pairs_related", F.count_if(F.col("grade") != "none"), F.count(one))).alias("x")))
    garbage = rows(good.agg(F.array(metric("symbols_garbage", F.count_if(F.trim("definition").rlike(L.GARBAGE)), F.count(one))).alias("x")))
    out = papers.unionByName(every).unionByName(pairs).unionByName(garbage)
    return out.withColumn("share", share(F.col("n"), F.col("total")))


def rates(rows: DataFrame, col: str, pattern: str, by: list[str]) -> DataFrame:
    """(by, n, total, share) of texts that a pattern matches somewhere; null texts don't count."""
    hit = F.col(col).rlike(pattern)
    return rows.groupBy(*by).agg(F.count_if(hit).alias("n"), F.count(col).alias("total")).withColumn("share", share(F.col("n"), F.col("total")))


def relation_validity(relations: DataFrame, eqs: DataFrame, grades: list[str]) -> DataFrame:
    """One row (valid, missing, bad): relations with a known grade and a description, pairs without one, others."""
    want = eqs.select("id", F.col("eq_num").alias("a")).join(eqs.select("id", F.col("eq_num").alias("b")), "id").where("a <> b")
    gaps = want.join(relations.select("id", "a", "b"), ["id", "a", "b"], "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    good = F.coalesce(F.col("grade").isin(grades), F.lit(False)) & F.col("description").isNotNull()
    return relations.agg(F.count_if(good).alias("valid"), F.count_if(~good).alias("bad")).crossJoin(gaps)  # one row each


def grades(relations: DataFrame) -> DataFrame:
    """(grade, n, share) of all pairs."""
    return _of_total(relations.groupBy("grade").agg(F.count(F.lit(1)).alias("n")), "n")


def strategies(audit: DataFrame) -> DataFrame:
    """(strategy, n, share) of the choices of meanings."""
    found = audit.where("key = 'meaning'").select(F.nullif(F.regexp_extract("detail", r"strategy=(\S+)", 1), F.lit("")).alias("strategy")).where("strategy IS NOT NULL")
    return _of_total(found.groupBy("strategy").agg(F.count(F.lit(1)).alias("n")), "n")


def common_descriptions(relations: DataFrame, k: int = 8, width: int = 60) -> DataFrame:
    """(head, n): the k commonest beginnings of descriptions of strong relations, ties in order of the text."""
    d = relations.where("grade = 'strong'").groupBy(F.substring("description", 1, width).alias("head")).agg(F.count(F.lit(1)).alias("n"))
    return d.orderBy(F.desc("n"), "head").limit(k)


def breakdown(eqs: DataFrame) -> DataFrame:
    """(latex_method, html, pdf, none): formulas by method and source."""
    return eqs.groupBy("latex_method").pivot("source", ["html", "pdf", "none"]).agg(F.count(F.lit(1))).na.fill(0)


def strategy_pivot(papers: DataFrame, meanings: DataFrame, names: list[str]) -> DataFrame:
    """(paper, <strategy>..., none, total) a paper, and a row TOTAL; `meanings` is (id, eq_num, strategy)."""
    m = meanings.select(F.col("id").cast("string").alias("paper"), F.coalesce("strategy", F.lit("none")).alias("strategy"))
    cols = [F.count_if(F.col("strategy") == n).alias(n) for n in [*names, "none"]]
    out = m.rollup("paper").agg(*cols, F.count(F.lit(1)).alias("total"), F.grouping("paper").alias("_g")).withColumn("paper", F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("paper"))).drop("_g")
    lone = papers.select(F.col("id").cast("string").alias("paper")).join(m.select("paper"), "paper", "left_anti")
    zero = [F.lit(0).cast("long").alias(n) for n in [*names, "none", "total"]]
    return out.unionByName(lone.select("paper", *zero))


def formats(entries: DataFrame) -> DataFrame:
    """One row: counts of signs of the present and of the earlier format, and the verdict PASS, MIXED or FAIL."""
    at = lambda name, kind: F.from_json(F.try_element_at("entry", F.lit(name)), kind)
    e = entries.where("entry IS NOT NULL").select(F.map_entries(at("relations", "map<string,variant>")).alias("rels"), at("audit-trail", "map<string,string>").alias("trail"))
    kind = lambda r: F.schema_of_variant(r["value"])
    new_rel = F.size(F.filter("rels", lambda r: kind(r).startswith("OBJECT") & F.try_variant_get(r["value"], "$.grade", "variant").isNotNull()))
    old_rel = F.size(F.filter("rels", lambda r: kind(r).startswith("ARRAY")))
    meaning = F.coalesce(F.try_element_at("trail", F.lit("meaning")), F.lit(""))
    weighted = F.contains(meaning, F.lit("strategy=weighted"))
    old = ~weighted & meaning.rlike("strategy=(tfidf|gazetteer|citation)")
    rejects = F.coalesce(F.exists(F.map_keys("trail"), lambda k: k.startswith("symbol_reject")), F.lit(False))
    mathml = F.contains(F.coalesce(F.try_element_at("trail", F.lit("symbol_source")), F.lit("")), F.lit("MathML"))
    total = lambda c: F.coalesce(F.sum(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))), F.lit(0))
    out = e.agg(total(new_rel).alias("relations_new"), total(old_rel).alias("relations_old"), F.count_if(weighted).alias("strategy_weighted"), F.count_if(old).alias("strategy_old"), F.count_if(rejects).alias("symbol_reject_logged"), F.count_if(mathml).alias("symbol_source_mathml"))
    olds, news = F.col("relations_old") + F.col("strategy_old"), F.col("relations_new") + F.col("strategy_weighted") + F.col("symbol_reject_logged") + F.col("symbol_source_mathml")
    return out.withColumn("verdict", F.when((olds > 0) & (news == 0), "FAIL").when(olds > 0, "MIXED").otherwise("PASS"))


def write_sheets(sheets: dict[str, DataFrame], folder: str) -> None:
    """Write each table as CSV files with a header under folder/name."""
    for name, df in sheets.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder.rstrip('/')}/{name}")


def report(rows: DataFrame, columns: list[str], width: int = 55) -> DataFrame:
    """(line) rows side by side: each value cut to `width` characters and padded, columns parted by a bar."""
    return rows.select(F.array_join(F.array(*[F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("N/A")), width, " ") for c in columns]), " | ").alias("line"))
