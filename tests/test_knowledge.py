import json

import pytest
from pyspark.sql import functions as F

from eqloom.functions import text as T
from eqloom.operators import documents as D
from eqloom.operators import knowledge as K
from eqloom.operators import meaning as M
from eqloom.operators import quality as Q
from eqloom.operators import relations as E
from eqloom.operators import symbols as S


def eqn(n, tex, mi="", cls="ltx_tag_equation"):
    return f'<table class="ltx_eqn_table" id="S1.E{n}"><tr><td><math alttext="{tex}">{mi}</math><span class="{cls}">({n})</span></td></tr></table>'


def para(n, *parts):
    return f'<div class="ltx_para" id="S1.p{n}">' + "".join(f'<p class="ltx_p">{p}</p>' if p[0] != "<" else p for p in parts) + "</div>"


PAPER = (
    '<section id="S1"><h2 class="ltx_title">Spin model</h2>'
    + para(1, "The Hamiltonian of the chain describes the energy of all spins (1).", eqn(1, "H=J", "<mi>H</mi><mi>J</mi>"), "where H is the total energy operator, and J is the coupling strength constant.")
    + para(2, "The Hamiltonian of the chain describes the energy of all spins (1).", eqn(2, "E=\\hbar\\omega", "<msub><mi>E</mi><mn>0</mn></msub><mi>ω</mi><mi>exp</mi>"), "Substituting Eq. (1) yields the lowest level of it.")
    + para(4, "A far remark about nothing in particular.", eqn(3, "H=E", "<mi>H</mi>"), 'See <a class="ltx_ref" href="#S1.E2">(2)</a> and also (9) for the level.')
    + "</section>"
)


@pytest.fixture(scope="module")
def t(spark):
    return K.analyse(spark.createDataFrame([(1, PAPER), (2, None), (3, "<p>no formulas")], "i long, h string"), "i", "h")


def test_passages(t):
    c = t["chunks"].orderBy("chunk_ord").collect()
    assert [r.chunk_ord for r in c] == list(range(len(c)))
    near = [r for r in c if r.chunk_type == "equation_neighborhood"]
    assert near[0].text.startswith("Spin model The Hamiltonian of the chain") and " H=J where H is" in near[0].text
    assert [r.eq_nums for r in near] == [["1"], ["2"], ["3"]]
    for r in c:
        if r.chunk_type == "sentence":
            whole = next(p.text for p in c if p.chunk_type == "paragraph" and p.para_id == r.para_id)
            assert whole[r.char_offset :].startswith(r.text)


def test_cross_references(t):
    got = [(r.from_para_id, r.to_eq_num, r.source) for r in t["xrefs"].orderBy("ord").collect()]
    assert got == [("S1.p4", "2", "structural"), ("S1.p1", "1", "lexical"), ("S1.p2", "1", "lexical"), ("S1.p4", "9", "lexical")]


def test_meanings_are_not_shared(t):
    got = {r.eq_num: r for r in t["meanings"].collect()}
    # the best passage is the neighbourhood, which opens with the section's title
    assert got["1"].meaning == "Spin model The Hamiltonian of the chain describes the energy of all spins (1)."
    assert {"eq_num", "definitional", "gazetteer", "same_section"} <= set(got["1"].signals)
    said = [r.meaning for r in got.values() if r.meaning]
    assert len(said) == len(set(said))


def test_symbols(t):
    rows = t["symbols"].collect()
    good = {(r.eq_num, r.sym): (r.definition, r.pattern) for r in rows if r.reject_reason is None}
    assert good[("1", "H")] == ("total energy operator", "where_is") and good[("1", "J")] == ("coupling strength constant", "sym_is")
    assert {r.sym for r in rows if r.eq_num == "2"} <= {"E_0", "E", "omega"}


def test_relations(t):
    got = {(r.a, r.b): r for r in t["relations"].collect()}
    assert len(got) == 6
    assert got[("2", "1")].grade == "strong" and "crossref+graph" in got[("2", "1")].signals and "deriv_cue" in got[("2", "1")].signals
    assert got[("3", "2")].grade == "strong" and got[("3", "2")].description.startswith("See (2)")
    for r in got.values():
        assert (r.description == "") == (r.grade == "none")


def test_document_is_valid_and_defects_are_found(spark, t):
    doc = json.loads(K.to_document(K.entries(t)).first().json)
    assert list(doc) == ["1", "2", "3"] and list(doc["1"]) == K.FIELDS
    read = lambda d: K.read_document(spark.createDataFrame([(json.dumps({"p": d, "empty": {}}),)], "value string"))
    K.validate(read(doc))
    del doc["1"]["relations"]["3"], doc["2"]["meaning"]
    doc["2"]["relations"]["1"]["grade"] = "odd"
    doc["3"]["audit-trail"], doc["3"]["_audit"], doc["1"]["symbols"] = {}, "x", 5
    got = {(r.eq_num, r.problem) for r in K.violations(read(doc)).collect()}
    assert {("1", "no relation to 3"), ("1", "symbols is no object"), ("2", "missing field meaning"), ("2", "bad relation to 1"), ("3", "private field _audit"), ("3", "relations without audit")} <= got
    with pytest.raises(ValueError):
        K.validate(read(doc))


def test_audit_keys_repeat_with_numbers(t):
    keys = [r.key for r in t["audit"].where("eq_num = '1' AND method = 'relations'").orderBy("seq").collect()]
    assert keys == ["relations", "relations_1"]
    one = {r.key: r.detail for r in t["audit"].where("eq_num = '1'").collect()}
    assert one["retrieval"].startswith("eq=(1): BM25 query='equation 1 eq 1") and "hits=" in one["retrieval"]
    assert "signals=['" in one["meaning"] and "sentence='Spin model" in one["meaning"]


def test_span_of_a_later_sentence(spark):
    text = "Short start of it all.  The second sentence denotes (1) the energy of it."
    p = spark.createDataFrame([(1, 0, "c", "S", "p", 40, text)], "id long, chunk_ord int, chunk_id string, section_id string, para_id string, char_offset int, text string")
    got = {r.s: r.char_offset for r in M._prose(p).collect()}
    clean = text.replace("  ", " ")
    assert got == {s: 40 + clean.index(s) for s in got} and len(got) == 2


def test_pdf_papers_and_the_stop_rule(spark):
    page = lambda n: '<section id="S1">' + "".join(para(i, f"Words of part {i}.", eqn(i, "H=J", "<mi>H</mi>")) for i in range(1, n + 1)) + "</section>"
    pages = spark.createDataFrame([(1, 2, page(2)), (2, 1, None), (3, 3, page(1)), (4, 4, page(3)), (5, 5, None)], "i long, place long, h string")
    lines = spark.createDataFrame([(2, 1, 0, "The energy of the whole system is"), (2, 1, 1, "E = mc2   (7)"), (1, 1, 0, "not read   (9)")], "id long, page int, line_no int, line string")
    t = K.analyse(pages, "i", "h", pdf_lines=lines, order_col="place", limit=3)
    assert {(r.id, r.source) for r in t["papers"].collect()} == {(2, "pdf"), (1, "html")}  # 1 + 2 formulas come before paper 3
    assert {(r.id, r.eq_num, r.source, r.latex_method) for r in t["equations"].collect()} == {(2, "7", "pdf", "pdf_text"), (1, "1", "html", "alttext"), (1, "2", "html", "alttext")}
    assert {r.id for r in t["meanings"].collect()} == {1, 2}
    every = K.analyse(pages, "i", "h", pdf_lines=lines)
    assert {(r.id, r.source) for r in every["papers"].collect()} == {(1, "html"), (2, "pdf"), (3, "html"), (4, "html"), (5, "none")}
    got = {r.id: (r.n, r.status) for r in Q.per_paper(every["papers"], every["equations"]).collect()}
    assert got[5] == (0, "EMPTY") and got[2] == (1, "UNDER")
    by = {r.latex_method: (r.html, r.pdf) for r in Q.breakdown(every["equations"]).collect()}
    assert by == {"alttext": (6, 0), "pdf_text": (0, 1)}


def test_formats_of_old_and_mixed_output(spark):
    old = {"relations": {"2": ["3"]}, "audit-trail": {"meaning": "strategy=tfidf_rank"}}
    new = {"relations": {"2": {"grade": "none", "description": ""}}, "audit-trail": {"meaning": "strategy=weighted", "symbol_source": "MathML <mi>", "symbol_reject_1": "x"}}
    read = lambda d: K.read_document(spark.createDataFrame([(json.dumps({"p": d}),)], "value string"))
    verdict = lambda d: tuple(Q.formats(read(d)).first())
    assert verdict({"1": old}) == (0, 1, 0, 1, 0, 0, "FAIL") and verdict({"1": old, "2": new}) == (1, 1, 1, 1, 1, 1, "MIXED") and verdict({}) == (0, 0, 0, 0, 0, 0, "PASS")


def test_sheets_and_report(spark, tmp_path):
    d = spark.createDataFrame([("1", None), ("2", "x" * 70)], "eq_num string, annotation string")
    Q.write_sheets({"rows": d}, str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "rows")).count() == 2
    assert {r.line for r in Q.report(d, ["eq_num", "annotation"], 5).collect()} == {"1     | N/A  ", "2     | xxxxx"}


def test_rejected_whatever_the_case(spark):
    r = lambda d, s, o: spark.range(1).select(T.reject_reason(F.lit(d), F.lit(s), F.array(*[F.lit(x) for x in o])).alias("r")).first().r
    assert r("psi", "H", ["H", "Psi"]) == "def_equals_other_symbol" and r("Psi", "H", ["H", "Psi"]) == "def_equals_other_symbol" and r("energy level", "H", ["H", "Psi"]) is None


def test_greedy_choice_against_a_loop(spark):
    import random

    rng = random.Random(5)
    cands = [(p, str(e), f"s{rng.randrange(6)}", rng.randrange(8), float(rng.randrange(3)), i, 0) for p in range(20) for e in range(1, 6) for i in range(rng.randrange(6))]
    df = spark.createDataFrame(cands, "id long, eq_num string, s string, points int, score double, rank int, pos int").withColumns({"chunk_id": F.lit("c"), "char_offset": F.lit(0), "signals": F.array(F.lit("x"))})
    eqs = spark.createDataFrame([(p, str(e), 6 - e) for p in range(20) for e in range(1, 6)], "id long, eq_num string, eq_ord int")
    want = {}
    for p in range(20):
        used = set()
        for e in range(5, 0, -1):  # document order is the reverse of the numbers here
            own = sorted((c for c in cands if c[0] == p and c[1] == str(e) and c[3] >= 3 and c[2] not in used), key=lambda c: (-c[3], -c[4], c[5]))
            want[p, str(e)] = own[0][2] if own else ""
            used |= {own[0][2]} if own else set()
    assert {(r.id, r.eq_num): r.meaning for r in M.choose(df, eqs).collect()} == want


def test_identifiers_and_order(spark):
    row = spark.createDataFrame([(["α", "x_1", "x", "exp", "2", "ϕ", "d"],)], "mi array<string>").select(S.keys_of_identifiers(F.col("mi")).alias("k")).first()
    assert row.k == ["alpha", "x_1", "x", "phi", "d"]
    n = spark.createDataFrame([(x,) for x in ("A.1", "10", "2", "1a")], "n string").orderBy(*D.order_of(F.col("n"))).collect()
    assert [r.n for r in n] == ["2", "10", "1a", "A.1"]


def test_citations(spark):
    text = "First one. By Eq. (2) we find more here! Again (2), yields that."
    r = spark.createDataFrame([(text, "2"), ("(2) is first of all of them.", "2"), ("none", "2")], "c string, b string").select(E.citation_sentence(F.col("b"), F.col("c")).alias("s"), E.cue_sentence(F.col("b"), F.col("c")).alias("q")).collect()
    assert [tuple(x) for x in r] == [("By Eq. (2) we find more here!", "Again (2), yields that."), (None, None), (None, None)]
