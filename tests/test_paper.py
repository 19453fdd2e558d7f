"""The analysis of a paper in one pass against the column expressions, and what it takes of the engine."""

import json
import random

import pytest
from pyspark.sql import functions as F

from eqloom.functions import text as T
from eqloom.operators import knowledge as K
from eqloom.operators import meaning as M
from eqloom.operators import paper as P
from eqloom.operators import relations as E
from eqloom.operators import symbols as S
from eqloom.plans import papers
from eqloom.sources import html as H

NAMES = ["equations", "chunks", "xrefs", "places", "asked", "meanings", "symbols", "relations", "audit"]


def rows(df, columns):
    return sorted(map(str, df.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.select(*columns).dtypes]).collect()))


def same(spark, pages):
    """With a table of PDF lines, even an empty one, the expressions do the analysis."""
    one, other = K.at_once(pages, "id", "html"), K.analyse(pages, "id", "html", pdf_lines=spark.createDataFrame([], "id long, page int, line_no int, line string"))
    for n in NAMES:
        assert one[n].select(*other[n].columns).dtypes == other[n].dtypes
        assert rows(one[n], other[n].columns) == rows(other[n], other[n].columns), n
    return one


def odd_page(rng):
    words = ["Eq.", "(1)", "(A.2)", "equation (2)", "where", "let", "H", "ψ", "\\psi", "ℏ", "is the", "denotes the", "mean energy", "be the", "phase², velocity", "density operator", "über", "yields", "substituting", "(3a).", "So it", "is.", "Then,", "the outer field", "e\u0301t\u00a0é", "italic_x", "x_{0}", "\\rho{x}", "\u200b", "master equation", "  ", "\u2003", "ſ", "İs", "gives", "represents!", "(Why?)", "\u2028", "script", "Bold", "{}", "ν²", "H, the", "$H$"]
    said = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(25)))
    out, n = [], 0
    for p in range(rng.randrange(1, 7)):
        parts = [f'<p class="ltx_p">{said()}</p>']
        for _ in range(rng.randrange(3)):
            n += 1
            number = rng.choice([str(n), str(n), "A.2", "3a", "1"])
            mi = "".join(rng.choice(["<mi>H</mi>", "<mi>ψ</mi>", "<msub><mi>H</mi><mn>0</mn></msub>", "<mi>exp</mi>", "<mi>ħ</mi>"]) for _ in range(3))
            parts.append(f'<table class="ltx_eqn_table{rng.choice([" ltx_equation", " ltx_equationgroup"])}" id="S1.E{n}"><tr><td><math alttext="H=\\psi_{n}">{mi}</math></td><td><span class="ltx_tag_equation{rng.choice(["", "group", ""])}">({number})</span></td></tr></table>')
            parts.append(f'<p class="ltx_p">{said()} <a class="ltx_ref" href="#S1.E{rng.randrange(1, 6)}">({rng.randrange(1, 6)})</a></p>')
        where = rng.choice([f' id="S1.p{p}"', f' id="S1.p{p + 1}"', ""])
        out.append(rng.choice(["<section id=S1><h2 class=ltx_title>Spin\u00a0model</h2>", "", "</section>"]) + f'<div class="ltx_para"{where}>{"".join(parts)}</div>')
    return "".join(out)


def test_odd_pages(spark):
    rng = random.Random(3)
    pages = [(i, odd_page(rng)) for i in range(150)] + [(900, None), (901, ""), (902, "<p>no formula"), (None, odd_page(rng))]
    t = same(spark, spark.createDataFrame(pages, "id long, html string"))
    assert t["symbols"].count() > 20 and t["relations"].where("grade = 'strong'").count() > 20 and t["meanings"].where("meaning <> ''").count() > 20


def test_written_pages(spark, sf):
    same(spark, papers.pages(spark, sf).where("id < 60"))


def test_documents_are_those_of_the_tables(spark, sf):
    """What a worker writes is what the tables of the expressions give, in the same order."""
    rng = random.Random(6)
    odd = spark.createDataFrame([(i, odd_page(rng).replace("the ", 'the "\\x1f\\n" ')) for i in range(60)] + [(900, None), (901, ""), (902, "<p>no formula")], "id long, html string")
    for pages in (odd, papers.pages(spark, sf).where("id < 40")):
        at_once = K.at_once(pages, "id", "html")
        got = {r.id: json.loads(r.json, object_pairs_hook=list) for r in at_once["document"].collect()}
        other = K.analyse(pages, "id", "html", pdf_lines=spark.createDataFrame([], "id long, page int, line_no int, line string"))["document"]
        assert got == {r.id: json.loads(r.json, object_pairs_hook=list) for r in other.collect()} and len(got) > 20


def test_documents_are_not_shuffled(spark, sf, monkeypatch):
    monkeypatch.setattr(K, "keep", lambda df, tag: pytest.fail("the document needs no table"))
    plan = K.at_once(papers.pages(spark, sf).repartition(64), "id", "html")["document"]._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in ("Join", "Aggregate", "Window", "Sort") if x in plan]


def test_pages_are_dealt_out_in_several_rounds(spark):
    """One part more than cores would take twice as long as one less."""
    cores = spark.sparkContext.defaultParallelism
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("Some words of it. More words follow here.").alias("text"))
    assert H.templated(docs.repartition(cores + 1)).rdd.getNumPartitions() == 4 * cores and H.templated(docs.repartition(4 * cores + 1)).rdd.getNumPartitions() == 4 * cores + 1
    pages = H.templated(docs.repartition(cores + 1))
    assert {r.id for r in pages.collect()} == set(range(100))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup
    before = len(jobs(None))
    P.documents(pages, "id", "html")
    assert len(jobs(None)) == before  # the dealing waits until rows are asked for


@pytest.mark.parametrize("name", ["symbols", "relations"])
def test_pages_are_not_shuffled_for_a_table(spark, sf, monkeypatch, name):
    plans = []
    monkeypatch.setattr(K, "keep", lambda df, tag: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    K.at_once(papers.pages(spark, sf).repartition(64), "id", "html")[name]
    assert len(plans) == 1 and not [x for x in ("Join", "Aggregate", "Window", "Sort") if x in plans[0]]


def test_repeated_ids_are_one_paper(spark, sf):
    """Their formulas have one choice of numbers, so the expressions join them."""
    page = lambda n: f'<div class="ltx_para" id="p{n}"><p class="ltx_p">Words of it all.</p><table class="ltx_eqn_table" id="S1.E{n}"><tr><td><math alttext="x_{n}"></math><span class="ltx_tag_equation">(1)</span></td></tr></table></div>'
    t = K.analyse(spark.createDataFrame([(1, page(1)), (1, page(2)), (2, page(3))], "id long, html string"), "id", "html")
    assert sorted((r.id, r.eq_num) for r in t["equations"].collect()) == [(1, "1"), (2, "1")]


def test_texts_as_the_expressions_take_them(spark):
    texts = ["", " a ", "\u3000b\x85", "x\x1c y", "Plain text. Of it!", "A\u00a0b (1) \\rho{x}", "é² H³ where H is the mean²; x", "script_{x}", "Is defined  as (2.a) İt", "1 2 abc d é", "ΑΣ ΣΑΣ", "so.\u2003(It) is", "_italic italic_x e\u0301define ªdefine ²define édefine"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    c = F.col("t")
    got = df.select("t", T.clean_text(c), T.clean_context(c), T.sentences(c), T.tokens(c), T.is_prose(c), c.rlike(M.L.DEFINITION_CUE), E.bracketed(c)).collect()
    for r in got:
        t = r[0]
        assert [P.clean_text(t), P.clean_context(t), P.sentences(t), P.tokens(t), P.is_prose(t), P.CUE.on(t).search(t) is not None, list(dict.fromkeys(x.lower() for x in P.BRACKETED.findall(t)))] == list(r[1:]), t


def test_phrases_as_the_expressions_find_them(spark):
    rng = random.Random(4)
    words = ["where", "let", "H", "h", "ψ", "psi", "ħ", "is", "be", "the", "denotes", "energy", "of", ",", ".", "²", "é", "$H$", "H_0", "\u2003", "and", "field;", "corresponds to", "mean"]
    cases = [(s, " ".join(rng.choice(words) for _ in range(rng.randrange(3, 30)))) for s in ["H", "psi", "H_0", "hbar"] for _ in range(150)]
    df = spark.createDataFrame(cases, "s string, c string").withColumn("c", T.strip(F.col("c"))).withColumn("f", S.find(F.col("s"), F.col("c")))
    got = df.withColumn("r", T.reject_reason(F.col("f.definition"), F.col("s"), F.array(F.lit("Mean"), F.lit("H")))).collect()
    assert sum(r.f is not None for r in got) > 50
    for r in got:
        f = P.find(r.s, P.Context(r.c))
        assert f == (tuple(r.f) if r.f else None), r
        assert f is None or P.reject_reason(f[0], r.s, ["Mean", "H"]) == r.r


def test_an_element_of_text_alone_is_read_like_others():
    page = "<P class=x>a &amp; b</P><p>c</p >d<br>e</br><i></i><b>x<u>y</u></b><li>1<li>2</li><script>a</b></script>"
    shape = lambda n: n if isinstance(n, str) else (n.tag, [shape(k) for k in n.kids])
    assert shape(H.tree(page))[1] == [("p", ["a & b"]), ("p", ["c"]), "d", ("br", []), "e", ("i", []), ("b", ["x", ("u", ["y"])]), ("li", ["1"]), ("li", ["2"]), ("script", ["a</b>"])]


def test_grades_as_the_expressions_write_them(spark):
    for x in (0.375, 0.625, 0.333333, 0.6, 1.0, 0.845, 0.995):
        assert P.hundredths(x) == spark.range(1).select(F.format_string("%.2f", F.lit(x)).alias("x")).first().x
    for t in ("By italic-x (1) it is.", "A  b_{0} \\rho{x} {}", "ITALIC_x end_ARG", " é² "):
        assert P.evidence(t) == spark.range(1).select(E.clean(F.lit(t)).alias("x")).first().x


def test_a_table_that_comes_again_is_read_like_the_first():
    """The inside is that of the page before, the place that of its own page; a table that closes what is outside is no such table."""
    table = '<table class="ltx_equation ltx_eqn_table" id="S1.E1"><tr><td><math alttext="x"><mi>x</mi></math><span class="ltx_tag_equation">(1)</span></td></tr></table>'
    odd = '<table class="ltx_eqn_table" id="S1.E2"><tr><td><span class="ltx_tag_equation">(2)</span><math alttext="y"></math></div></td></tr></table>'
    pages = [f'<section id="S{k}"><div class="ltx_para" id="p{k}"><p class="ltx_p">Words {k}.</p>{table}{odd if k % 2 else ""}{table}<p class="ltx_p">More.</p></div></section>' for k in range(4)]
    seen: dict = {}
    for i, page in enumerate(pages):
        assert list(H.rows(i, page, H.KINDS, 7, seen)) == list(H.rows(i, page, H.KINDS, 7))
    assert len(seen[H.TABLES]) == 1


def test_entries_are_read_once_for_all_their_faults(spark):
    texts = spark.range(1).select(F.lit('{"p": {"1": {"relations": {"2": {"grade": "odd", "description": ""}, "4": {"grade": "none"}}}, "2": {}, "3": {"relations": []}}, "q": {}}').alias("value"))
    v = K.violations(K.read_document(texts))
    assert v._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    got = {(r.eq_num, r.problem) for r in v.collect() if "relation" in r.problem}
    assert got == {("1", "bad relation to 2"), ("1", "bad relation to 4"), ("1", "no relation to 3"), ("1", "relations without audit"), ("2", "missing field relations"), ("3", "relations is no object")} | {(a, f"no relation to {b}") for a in "23" for b in "123" if a != b}
