"""The whole analysis of papers: audit, assembled entries, their validation and quality figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eqloom import lexicon as L
from eqloom.operators import documents as D
from eqloom.operators import meaning as M
from eqloom.operators import paper as P
from eqloom.operators import relations as E
from eqloom.operators import retrieval as R
from eqloom.operators import symbols as S
from eqloom.sources import html as H
from eqloom.sources.durable import keep

FIELDS = ["equation", "meaning", "symbols", "relations", "audit-trail"]
PRIVATE = ["_ctx_before", "_ctx_after", "_audit"]
GRADES = ["none", "strong", "potential"]
ENTRY = "map<string,map<string,map<string,string>>>"
DEPTHS = {"m": M.DEPTH, "s": S.DEPTH, "r": E.DEPTH}


class Tables(dict):
    """Tables by name, each made when it is first asked for.  A copy may replace some; the others stay those of the original."""

    def __init__(self, made: dict, makers: dict) -> None:
        super().__init__(made)
        self.makers = makers

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.makers[name]()
        return self[name]

    def copy(self) -> Tables:
        return Tables({}, {name: (lambda name=name: self[name]) for name in {*self, *self.makers}})


def analyse(pages: DataFrame, id_col: str, html_col: str, cap: int = D.CAP, pdf_lines: DataFrame | None = None, order_col: str | None = None, limit: int | None = None) -> Tables:
    """Tables by name: papers, equations, chunks, xrefs, meanings, symbols, relations, asked, audit, document (the JSON of to_document).

    A paper's source is html if its page is not null, else pdf if `pdf_lines` (id, page, line_no, line)
    has it, else none; a paper without formulas has a row in papers alone.  With `limit`, papers count
    in the order of `order_col` (their id, if none is given) as long as those before them hold fewer formulas; later
    ones are in no table.  Papers that are pages alone, with ids that don't repeat, are analysed one at a time (`at_once`).
    Otherwise pages are parsed once; node rows, formulas, passages and hits are
    written to the shared folder, each when a table that needs it is first asked for.
    """
    if pdf_lines is None and limit is None and pages.groupBy(F.col(id_col).cast("long").alias("id")).count().where("id is not null and count > 1").isEmpty():
        return at_once(pages, id_col, html_col, cap, order_col)
    papers = pages.select(F.col(id_col).cast("long").alias("id"), F.col(order_col or id_col).cast("long").alias("ord"), F.col(html_col).isNotNull().alias("html")).where("id is not null")
    has = F.lit(None).cast("boolean")
    if pdf_lines is not None:
        papers, has = papers.join(pdf_lines.select("id").distinct().withColumn("pdf", F.lit(True)), "id", "left"), F.col("pdf")
    papers = papers.select("id", "ord", F.when(F.col("html"), "html").when(has, "pdf").otherwise("none").alias("source"))
    nodes = keep(H.nodes(pages, id_col, html_col, D.PARTS, cap), "nodes")
    if pdf_lines is None:  # all formulas are those of node rows, and the papers need not be looked up
        found = D.equations(nodes, cap)
    else:
        found = D.extract(papers, nodes, pdf_lines, cap)
    eqs = keep(found, "equations")
    if limit is not None:
        papers = keep(D.until(papers, eqs, limit), "papers")
        nodes, eqs = (x.join(papers.select("id"), "id", "left_semi") for x in (nodes, eqs))
    asked, hits = {"m": M, "s": S, "r": E}, {}

    def search(*kinds: str) -> None:
        """All questions that come up together are answered by one search, and only the passages that were found go on."""
        new = [k for k in kinds if k not in hits]
        if not new:
            return
        pieces = M.pool(t["chunks"])
        ask = [asked[k].asks(eqs).select("id", F.concat(F.lit(k + ":"), "name").alias("qid"), "text") for k in new]
        found = R.search_papers(pieces, reduce(DataFrame.unionByName, ask), max(DEPTHS[k] for k in new))
        found = keep(found.where(reduce(Column.__or__, [F.col("qid").startswith(k + ":") & (F.col("rank") <= DEPTHS[k]) for k in new])), "hits")
        met = keep(pieces.join(found.select("id", "chunk_ord").distinct(), ["id", "chunk_ord"], "left_semi"), "met")
        for k in new:
            hits[k] = found.where(F.col("qid").startswith(k + ":")).withColumn("name", F.substring("qid", 3, 1 << 20)).drop("qid"), met

    def meanings() -> DataFrame:
        search("m")
        own, met = hits["m"]
        return keep(M.choose(M.signals(M.candidates(eqs, met, own), t["places"]), eqs), "meanings")

    def symbols() -> DataFrame:
        search("s")
        own, met = hits["s"]
        return keep(S.definitions(eqs, met, own), "symbols")

    def relations() -> DataFrame:
        search("m", "s", "r")
        own, met = hits["r"]
        return keep(E.graded(eqs, t["places"], met, own, t["xrefs"], t["meanings"], t["symbols"]), "relations")

    def log() -> DataFrame:
        search("m")
        return M.retrieval_log(eqs, hits["m"][0])

    def trail() -> DataFrame:
        t["relations"]  # the one search for all
        return audit(t)

    makers = {
        "chunks": lambda: D.passages(nodes, eqs),
        "xrefs": lambda: keep(D.cross_references(nodes, t["chunks"]), "xrefs"),
        "places": lambda: keep(D.places(t["chunks"]), "places"),
        "meanings": meanings, "symbols": symbols, "relations": relations, "asked": log, "audit": trail, "document": lambda: to_document(entries(t)),
    }
    t = Tables({"papers": papers, "equations": eqs}, makers)
    return t


def at_once(pages: DataFrame, id_col: str, html_col: str, cap: int = D.CAP, order_col: str | None = None) -> Tables:
    """analyse for pages with ids that don't repeat: a worker parses a page and goes on to its results, so nothing is shuffled.

    What a table needs is written when it is first asked for, with all that comes out of the same work;
    what was not wanted then takes one more pass over the pages, with all that is left.
    """
    papers = pages.select(F.col(id_col).cast("long").alias("id"), F.col(order_col or id_col).cast("long").alias("ord"), F.when(F.col(html_col).isNotNull(), "html").otherwise("none").alias("source")).where("id is not null")
    every = {"equations", "asked", "meanings", "symbols", "relations"}
    first = {"equations": {"equations"}, "symbols": {"equations", "symbols"}, "meanings": {"equations", "asked", "meanings"}, "asked": {"equations", "asked", "meanings"}, "relations": every}
    made: dict[str, DataFrame] = {}

    def part(name: str) -> DataFrame:
        if name not in made:
            new = (every if made else first[name]) - set(made)
            rows = keep(P.studied(pages, id_col, html_col, new, cap), "papers")
            made.update({n: P.part(rows, n) for n in new})
        return made[name]

    def trail() -> DataFrame:
        part("relations")  # and all that is left with them
        return audit(t)

    lazy = lambda name: P.part(P.studied(pages, id_col, html_col, {name}, cap), name)
    makers = {name: (lambda name=name: part(name)) for name in every}
    # entries are written by the workers that analyse the pages, unless the analysis is there already
    document = lambda: to_document(entries(t)) if "relations" in made else P.documents(pages, id_col, html_col, cap)
    makers |= {"audit": trail, "document": document, "xrefs": lambda: keep(lazy("xrefs"), "xrefs"), "places": lambda: keep(lazy("places"), "places")}
    t = Tables({"papers": papers, "chunks": lazy("chunks")}, makers)  # passages are not written, since hardly anything asks for all of them
    return t


def keyed(rows: DataFrame) -> DataFrame:
    """rows with `key`: the first of a method keeps its name, the k-th repeat gets _k."""
    o = F.row_number().over(Window.partitionBy("id", "eq_num", "method").orderBy("seq"))
    return rows.withColumn("_o", o).withColumn("key", F.when(F.col("_o") == 1, F.col("method")).otherwise(F.concat("method", F.lit("_"), F.col("_o") - 1))).drop("_o")


def audit(t: dict[str, DataFrame], parts: tuple[str, ...] = ("equations", "asked", "meanings", "symbols", "relations")) -> DataFrame:
    """(id, eq_num, seq, method, detail, key): how each field came about, as far as the tables `parts` tell it.

    A method's rows come from one table, so their keys are the same with fewer parts.
    """
    row = lambda seq, method, detail: [F.col("id"), F.col("eq_num"), seq.cast("long").alias("seq"), method.alias("method"), detail.alias("detail")]
    eq = F.concat(F.lit("eq=("), "eq_num", F.lit(")"))
    quoted = lambda c, n: F.concat(F.lit("'"), F.substring(c, 1, n), F.lit("'"))
    out = []
    if "equations" in parts:
        out.append(t["equations"].select(*row(F.lit(0), F.lit("latex_method"), F.concat(eq, F.lit(": method="), "latex_method", F.lit(" latex="), quoted("equation", 60)))))
    if "asked" in parts:
        out.append(t["asked"].select(*row(F.lit(1), F.lit("retrieval"), F.concat(eq, F.lit(": BM25 query="), quoted("query", 60), F.format_string(" hits=%d", "hits")))))
    named = F.concat(F.lit("["), F.array_join(F.transform("signals", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    chosen = F.concat(eq, F.format_string(": strategy=weighted bm25=%.1f score=%d/15 chunk=%s char_span=[%d,%d] signals=%s sentence=", "bm25", "points", "chunk_id", "char_start", "char_end", named), quoted("meaning", 80))
    if "meanings" in parts:
        out.append(t["meanings"].select(*row(F.lit(2), F.lit("meaning"), F.when(F.col("meaning") == "", F.concat(eq, F.lit(": no sentence reaches the threshold"))).otherwise(chosen))))
    # formulas often share symbols, so the order within a formula is that of its symbols
    if "symbols" in parts:
        out.append(t["symbols"].select(*row(10 + F.col("ord"), F.when(F.col("reject_reason").isNull(), F.lit("symbol")).otherwise(F.lit("symbol_reject")), F.format_string("sym=%s def=%s confidence=%s pattern=%s chunk=%s reason=%s", "sym", F.substring("definition", 1, 60), "confidence", "pattern", "chunk_id", F.coalesce("reject_reason", F.lit("-"))))))
    if "relations" in parts:
        place = F.row_number().over(Window.partitionBy("id", "eq_num").orderBy(*D.order_of(F.col("b"))))
        out.append(t["relations"].withColumnRenamed("a", "eq_num").withColumn("_p", place).select(*row(1000 + F.col("_p"), F.lit("relations"), F.format_string("eq=(%s)~(%s): grade=%s signals=%s jaccard=%.2f sim=%.2f", "eq_num", "b", "grade", F.array_join("signals", ","), "jaccard", "cosine"))))
    return keyed(reduce(DataFrame.unionByName, out))


def entries(t: dict[str, DataFrame]) -> DataFrame:
    """(id, eq_num, equation, meaning, symbols, relations, audit): maps as JSON texts."""
    t["relations"]  # first, since the others come with them
    group = lambda df, key, k, v: df.groupBy("id", key).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(k).alias("k"), v.alias("v")))))).alias("m"))
    sym = group(t["symbols"].where("reject_reason IS NULL"), "eq_num", "sym", F.col("definition")).withColumnRenamed("m", "symbols")
    rel = group(t["relations"], "a", "b", F.struct("grade", "description")).withColumnsRenamed({"a": "eq_num", "m": "relations"})
    trail = group(t["audit"], "eq_num", "key", F.col("detail")).withColumnRenamed("m", "audit")
    e = t["equations"].select("id", "eq_num", "eq_ord", "equation").join(t["meanings"].select("id", "eq_num", "meaning"), ["id", "eq_num"], "left")
    for part in (sym, rel, trail):
        e = e.join(part, ["id", "eq_num"], "left")
    return e.select("id", "eq_num", "eq_ord", "equation", F.coalesce("meaning", F.lit("")).alias("meaning"), *[F.coalesce(c, F.lit("{}")).alias(c) for c in ("symbols", "relations", "audit")])


def to_document(e: DataFrame) -> DataFrame:
    """(id, json): one object a paper, formula numbers to entries of five fields."""
    fields = F.concat(F.lit('{"equation":'), _quoted("equation"), F.lit(',"meaning":'), _quoted("meaning"), F.lit(',"symbols":'), "symbols", F.lit(',"relations":'), "relations", F.lit(',"audit-trail":'), "audit", F.lit("}"))
    one = F.struct("eq_ord", F.concat(_quoted("eq_num"), F.lit(":"), fields).alias("x"))
    return e.groupBy("id").agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["x"]), ","), F.lit("}")).alias("json"))


def _quoted(col: str) -> Column:
    # an array of one text, without its brackets, is the text as JSON
    return F.regexp_replace(F.to_json(F.array(col)), r"(?s)^\[(.*)\]$", "$1")


def read_document(texts: DataFrame, col: str = "value") -> DataFrame:
    """(paper, eq_num, entry map<string,string>) of JSON texts {paper: {number: entry}}; values stay JSON."""
    papers = texts.select(F.explode(F.from_json(col, ENTRY)).alias("paper", "eqs"))
    return papers.select("paper", F.explode_outer("eqs").alias("eq_num", "entry"))


def violations(e: DataFrame) -> DataFrame:
    """(paper, eq_num, problem) of entries as read_document gives them."""
    e = e.where("eq_num IS NOT NULL")
    keys = F.coalesce(F.map_keys("entry"), F.array().cast("array<string>"))
    as_map = lambda name, kind: F.from_json(F.try_element_at("entry", F.lit(name)), kind)
    values = "map<string,variant>"  # a variant keeps the type that a value has in the JSON
    e = e.withColumns({"keys": keys, "syms": as_map("symbols", values), "rels": as_map("relations", values), "trail": as_map("audit-trail", values)})
    said = F.coalesce(F.try_element_at("entry", F.lit("meaning")), F.lit(""))
    lit = lambda names: F.array(*[F.lit(n) for n in names])
    words = lambda head, arr: F.transform(arr, lambda k: F.concat(F.lit(head), k))
    logged = lambda *heads: F.exists(F.coalesce(F.map_keys("trail"), F.array().cast("array<string>")), lambda k: k.rlike("^(?:" + "|".join(heads) + ")"))
    when = lambda c, text: F.when(F.coalesce(c, F.lit(False)), F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    text_at = lambda v, key: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")) == "STRING", F.try_variant_get(v, f"$.{key}", "string"))
    grades = F.transform(F.map_entries("rels"), lambda r: text_at(r["value"], "grade"))
    no_text = lambda name, c: F.coalesce(F.transform(F.filter(F.map_entries(c), lambda x: F.schema_of_variant(x["value"]) != "STRING"), lambda x: F.concat(F.lit(f"{name}/"), x["key"], F.lit(" is no text"))), F.array().cast("array<string>"))
    found = F.concat(
        words("missing field ", F.array_except(lit(FIELDS), "keys")),
        words("private field ", F.array_intersect(lit(PRIVATE), "keys")),
        *[when(F.array_contains("keys", name) & F.col(c).isNull(), f"{name} is no object") for name, c in (("symbols", "syms"), ("relations", "rels"), ("audit-trail", "trail"))],
        no_text("symbols", "syms"),
        no_text("audit-trail", "trail"),
        when((said != "") & ~logged("meaning", "retrieval"), "meaning without audit"),
        when((F.size("syms") > 0) & ~logged("symbol"), "symbols without audit"),
        when(F.exists(grades, lambda g: F.coalesce(g, F.lit("none")) != "none") & ~logged("relations"), "relations without audit"),
    )
    grade, text = (lambda r: text_at(r["value"], "grade")), (lambda r: text_at(r["value"], "description"))
    rels = F.coalesce(F.map_entries("rels"), F.array().cast("array<struct<key:string,value:variant>>"))
    wrong = F.filter(rels, lambda r: ~F.coalesce(grade(r).isin(GRADES), F.lit(False)) | text(r).isNull())
    # the texts are read once, and only what was found in them meets the paper's other numbers
    read = e.select("paper", "eq_num", F.concat(found, F.transform(wrong, lambda r: F.concat(F.lit("bad relation to "), r["key"]))).alias("found"), F.transform(rels, lambda r: r["key"]).alias("known"))
    read = read.withColumn("every", F.collect_list("eq_num").over(Window.partitionBy("paper")))
    others = F.filter("every", lambda b: (b != F.col("eq_num")) & ~F.array_contains("known", b))
    return read.select("paper", "eq_num", F.explode(F.concat("found", F.transform(others, lambda b: F.concat(F.lit("no relation to "), b)))).alias("problem"))


def validate(e: DataFrame, shown: int = 20) -> None:
    """Raise with the first problems, if there are any."""
    first = violations(e).orderBy("paper", "eq_num", "problem").limit(shown).collect()
    if first:
        raise ValueError("; ".join(f"{r.paper}/{r.eq_num}: {r.problem}" for r in first))
