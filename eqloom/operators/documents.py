"""The document model: formulas, passages and the graph of cross references, from node rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eqloom import lexicon as L
from eqloom.functions import text as T
from eqloom.sources.durable import keep

PARTS = frozenset({"equation", "para", "spot", "link"})
CAP, SENTENCE, EVIDENCE, STOP = 7, 10, 300, 350


def order_of(number: Column) -> list[Column]:
    """Sort keys of formula numbers: integers by value, then the others as text."""
    as_int = number.try_cast("int")
    return [as_int.isNull(), as_int, number]


def first_numbers(found: DataFrame, order: str, cap: int) -> DataFrame:
    """Rows (id, number, ...) with eq_ord: the first row of each number of a paper, `cap` numbers a paper."""
    one = found.withColumn("_o", F.row_number().over(Window.partitionBy("id", "number").orderBy(order))).where("_o = 1").drop("_o")
    return one.withColumn("eq_ord", F.row_number().over(Window.partitionBy("id").orderBy(order))).where(F.col("eq_ord") <= cap)


def equations(nodes: DataFrame, cap: int = CAP) -> DataFrame:
    """(id, eq_num, eq_ord, equation, source, latex_method, before, after, mi): a number's first formula, `cap` a paper.

    Formulas without a readable number are no rows; a missing context is empty.
    """
    e = first_numbers(nodes.where("kind = 'equation'"), "ord", cap)
    return e.select("id", F.col("number").alias("eq_num"), "eq_ord", F.col("latex").alias("equation"), F.lit("html").alias("source"), F.col("method").alias("latex_method"), F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"), "mi")


def pdf_equations(lines: DataFrame, cap: int = 7) -> DataFrame:
    """The same columns from the lines (id, page, line_no, line) of PDF texts.

    A formula is the text before two blanks and a number in brackets at a line's end, which may be
    a comma only; its context is the nearest line of four words among the 10 before and the 9 after.
    A null line holds nothing.
    """
    words = F.size(F.filter(F.split("line", r"(?U)\s+"), lambda x: x != ""))
    w = Window.partitionBy("id").orderBy("page", "line_no")
    near = lines.select("id", "page", "line_no", F.coalesce("line", F.lit("")).alias("line")).withColumn("_p", F.when(words >= 4, T.strip(F.col("line"))))
    near = near.withColumns({"before": F.last("_p", True).over(w.rowsBetween(-10, -1)), "after": F.first("_p", True).over(w.rowsBetween(1, 9)), "ord": F.row_number().over(w)})
    found = near.where(F.col("line").rlike(L.PDF_FORMULA))
    found = found.withColumns({"equation": T.strip(F.regexp_extract("line", L.PDF_FORMULA, 1)), "number": F.regexp_extract("line", L.PDF_FORMULA, 2)})
    e = first_numbers(found, "ord", cap)
    return e.select("id", F.col("number").alias("eq_num"), "eq_ord", "equation", F.lit("pdf").alias("source"), F.lit("pdf_text").alias("latex_method"), F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"), F.lit(None).cast("array<string>").alias("mi"))


def extract(papers: DataFrame, nodes: DataFrame, pdf_lines: DataFrame | None = None, cap: int = 7) -> DataFrame:
    """Formulas by the source of each paper (id, source): html from node rows, pdf from lines, none has no rows."""
    of = lambda e: e.join(papers.select("id", "source"), ["id", "source"], "left_semi")
    out = of(equations(nodes, cap))
    return out if pdf_lines is None else out.unionByName(of(pdf_equations(pdf_lines, cap)))


def running_before(rows: DataFrame, order: str, value: str) -> DataFrame:
    """rows with `before`, the sum of `value` over the rows earlier in `order` (a unique column).

    Rows are dealt out by ranges of `order`; one sum a range is added up in one place, the rest
    within the ranges, so no task sees all rows.
    """
    parts = keep(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # one row a range
    sums = parts.groupBy("_part").agg(F.sum(value).alias("_s")).withColumn("_base", F.sum("_s").over(up_to(Window.orderBy("_part"))))
    out = parts.join(F.broadcast(sums.select("_part", "_base")), "_part")
    inner = F.sum(value).over(up_to(Window.partitionBy("_part").orderBy(order)))
    return out.withColumn("before", (F.coalesce(inner, F.lit(0)) + F.coalesce("_base", F.lit(0))).cast("long")).drop("_part", "_base")


def until(papers: DataFrame, eqs: DataFrame, limit: int = STOP) -> DataFrame:
    """papers (id, ord, ...) with n and before, as far as the papers before hold fewer than `limit` formulas."""
    n = eqs.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    counted = papers.join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return running_before(counted, "ord", "n").where(F.col("before") < limit)


def fragments(nodes: DataFrame) -> DataFrame:
    """(id, table_index, classes, eq_num, has_math, has_annotation, annotation_preview, alttext_preview, html) of every equation table."""
    f = nodes.where("kind = 'fragment'")
    place = F.row_number().over(Window.partitionBy("id").orderBy("ord")) - 1
    return f.select("id", place.alias("table_index"), "classes", F.col("text").alias("eq_num"), F.col("method").isNotNull().alias("has_math"), F.col("latex").isNotNull().alias("has_annotation"), F.col("latex").alias("annotation_preview"), F.col("before").alias("alttext_preview"), F.col("after").alias("html"))


def methods(nodes: DataFrame) -> DataFrame:
    """(id, eq_num, annotation, alttext, mathml, alttext_equal, mathml_equal): the three ways to each number's LaTeX."""
    m = nodes.where("kind = 'methods'").select("id", "ord", F.col("number").alias("eq_num"), F.col("latex").alias("annotation"), F.col("text").alias("alttext"), F.col("before").alias("mathml"))
    return m.withColumns({"alttext_equal": F.col("alttext") == F.col("annotation"), "mathml_equal": F.col("mathml") == F.col("annotation")})


def passages(nodes: DataFrame, eqs: DataFrame) -> DataFrame:
    """(id, chunk_ord, chunk_id, chunk_type, text, section_id, section_title, para_id, eq_nums, char_offset).

    Paragraphs without an id or without prose have no rows.  Sentences of at least ten characters, paragraphs, then the neighbourhood of each formula in
    order of their numbers; one counter runs over all passages of a paper.
    """
    only = lambda kind, *cols: F.when(F.col("kind") == kind, F.struct(*cols))
    own = only("para", "ord", T.clean_text(F.col("text")).alias("text"), "section_id", "title", "para_id")
    box = only("spot", "ord", "number", "method", "before", "after", "section_id", "title", "para_id")
    # the one shuffle: a paper's paragraphs, tables and formulas come together in a row, and its passages out of it in their order
    paper = nodes.where("kind IN ('para', 'spot')").select("id", own.alias("p"), box.alias("s")).groupBy("id").agg(F.collect_list("p").alias("p"), F.collect_list("s").alias("s"))
    held = eqs.select("id", F.struct("eq_num", "equation", "eq_ord").alias("e"))
    paper = paper.join(held.groupBy("id").agg(F.collect_list("e").alias("e")), "id", "left")
    spots = F.array_sort("s")
    beside = F.filter(spots, lambda x: (x["method"] == "child") & x["para_id"].isNotNull())

    def numbers(x: Column) -> Column:
        found = F.transform(F.filter("beside", lambda y: y["para_id"] == x["para_id"]), lambda y: y["number"])
        return F.array_distinct(found)

    def passage(kind: str, x: Column, text: Column, nums: Column, start: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), text.alias("text"), x["section_id"].alias("section_id"), x["title"].alias("title"), x["para_id"].alias("para_id"), nums.alias("eq_nums"), start.alias("start"))

    paper = paper.withColumns({"beside": beside, "spots": spots, "p": F.filter(F.array_sort("p"), lambda x: x["text"] != "")})
    paper = paper.withColumn("q", F.transform("p", lambda x: F.struct(*[x[c].alias(c) for c in ("text", "section_id", "title", "para_id")], T.sentences(x["text"]).alias("l"), numbers(x).alias("n"))))

    def cut(x: Column) -> Column:
        # the cleaner leaves one blank between sentences
        start = lambda pos: F.when(pos == 0, 0).otherwise(F.length(F.array_join(F.slice(x["l"], F.lit(1), pos), " ")) + 1)
        return F.filter(F.transform(x["l"], lambda y, pos: passage("sentence", x, T.strip(y), x["n"], start(pos))), lambda y: F.length(y["text"]) >= SENTENCE)

    some = lambda c: F.nullif(c, F.lit(""))

    def around(e: Column) -> Column:
        x = F.try_element_at(F.filter("spots", lambda y: y["number"] == e["eq_num"]), F.lit(1))
        as_int = e["eq_num"].try_cast("int")
        return F.struct(as_int.isNull().alias("a"), F.coalesce(as_int, F.lit(0)).alias("b"), e["eq_ord"].alias("d"), e["equation"].alias("equation"), x.alias("x"))

    def near(y: Column) -> Column:
        x = y["x"]
        text = F.concat_ws(" ", some(x["title"]), some(T.clean_text(x["before"])), some(y["equation"]), some(T.clean_text(x["after"])))
        return passage("equation_neighborhood", x, text, numbers(x), F.lit(0))

    none = F.array().cast("array<struct<eq_num:string,equation:string,eq_ord:int>>")
    told = F.array_sort(F.filter(F.transform(F.coalesce("e", none), around), lambda y: y["x"].isNotNull()))
    whole = F.transform("q", lambda x: passage("paragraph", x, x["text"], x["n"], F.lit(0)))
    every = F.concat(F.flatten(F.transform("q", cut)), whole, F.filter(F.transform(told, near), lambda y: y["text"] != ""))
    every = paper.select("id", F.posexplode(every).alias("chunk_ord", "x")).select("id", "chunk_ord", "x.*")
    sec = F.coalesce("section_id", F.lit(""))
    out = every.select(
        "id", "chunk_ord", F.concat_ws(":", "id", sec, "type", "chunk_ord").alias("chunk_id"), F.col("type").alias("chunk_type"), "text", sec.alias("section_id"),
        F.coalesce("title", F.lit("")).alias("section_title"), F.coalesce("para_id", F.lit("")).alias("para_id"), F.coalesce("eq_nums", F.array().cast("array<string>")).alias("eq_nums"), F.col("start").alias("char_offset"),
    )
    return keep(out, "chunks")


def cross_references(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, ord, from_para_id, sentence, to_eq_num, source).

    Links come first, resolved by the id of their target or else by the number they show, with
    repeats; then one lexical row for each paragraph and number that no link covers.
    """
    known = nodes.where("kind = 'spot'").groupBy("id", F.col("elem_id").alias("href")).agg(F.min_by("number", "ord").alias("number"))
    link = nodes.where("kind = 'link' AND para_id IS NOT NULL").where(F.col("href").rlike(L.LINK_TARGET))
    shown = F.nullif(F.regexp_extract("text", L.LINK_NUMBER, 1), F.lit(""))
    link = link.drop("number").join(known, ["id", "href"], "left")
    link = link.select("id", "ord", F.col("para_id").alias("from_para_id"), F.substring(T.clean_text(F.coalesce("before", F.lit(""))), 1, EVIDENCE).alias("sentence"), F.coalesce("number", shown).alias("to_eq_num"), F.when(F.col("number").isNotNull(), "structural").otherwise("structural_text").alias("source")).where("to_eq_num IS NOT NULL")
    cited = chunks.where("chunk_type = 'sentence'").select("id", "chunk_ord", F.col("para_id").alias("from_para_id"), F.col("text").alias("sentence"), F.explode(F.array_distinct(T.cited_numbers(F.col("text")))).alias("to_eq_num"))
    free = cited.join(link.select("id", "from_para_id", "to_eq_num").distinct(), ["id", "from_para_id", "to_eq_num"], "left_anti")
    lexical = free.groupBy("id", "from_para_id", "to_eq_num").agg(F.min_by("sentence", "chunk_ord").alias("sentence"), F.min("chunk_ord").alias("c"))
    # lexical rows follow every link of their paper
    lexical = lexical.select("id", (F.col("c") + (1 << 30)).alias("ord"), "from_para_id", F.substring("sentence", 1, EVIDENCE).alias("sentence"), "to_eq_num", F.lit("lexical").alias("source"))
    return link.unionByName(lexical)


def places(chunks: DataFrame) -> DataFrame:
    """(id, eq_num, section_id, para_id): where a formula is, by the first neighbourhood that names it."""
    n = chunks.where("chunk_type = 'equation_neighborhood'").select("id", "chunk_ord", "section_id", "para_id", F.explode("eq_nums").alias("eq_num"))
    return n.groupBy("id", "eq_num").agg(F.min_by("section_id", "chunk_ord").alias("section_id"), F.min_by("para_id", "chunk_ord").alias("para_id"))


def naming(chunks: DataFrame, forms: list[str]) -> DataFrame:
    """The passages that hold any of the surface forms, as they are written."""
    return chunks.where(F.exists(F.array(*[F.lit(f) for f in forms]), lambda f: F.contains("text", f)))


def next_to(paras: DataFrame, others: DataFrame, key: str = "para_id") -> DataFrame:
    """Pairs of rows whose paragraph ids are adjacent, by an equi-join: columns of `others` get the suffix _b.

    Each paragraph asks for the numbers one below and one above, so no band has to be scanned.
    """
    part = lambda c, i: F.nullif(F.regexp_extract(c, L.PARAGRAPH, i), F.lit(""))
    a = paras.select("*", part(F.col(key), 1).alias("_s"), F.explode(F.array(part(F.col(key), 2).try_cast("long") - 1, part(F.col(key), 2).try_cast("long") + 1)).alias("_p"))
    b = others.select(*[F.col(c).alias(c + "_b") for c in others.columns], part(F.col(key), 1).alias("_s"), part(F.col(key), 2).try_cast("long").alias("_p"))
    return a.join(b, ["_s", "_p"]).drop("_s", "_p")


def adjacent(a: Column, b: Column) -> Column:
    """Whether two paragraph ids share their prefix and differ by one in their number."""
    return next_numbers(paragraph(a), paragraph(b))


def paragraph(c: Column) -> Column:
    """struct(prefix, number) of a paragraph id; null where it has none."""
    part = lambda i: F.nullif(F.regexp_extract(c, L.PARAGRAPH, i), F.lit(""))
    return F.struct(part(1).alias("prefix"), part(2).try_cast("long").alias("number"))


def next_numbers(a: Column, b: Column) -> Column:
    """adjacent, of what `paragraph` gives: worth having once a row where a row meets many."""
    return F.coalesce((a["prefix"] == b["prefix"]) & (F.abs(a["number"] - b["number"]) == 1), F.lit(False))
