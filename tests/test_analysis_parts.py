"""An analysis makes only the tables that are asked for, and keeps no more than they need."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from eqloom.operators import documents as D
from eqloom.operators import knowledge as K
from eqloom.operators import meaning as M
from eqloom.plans import papers
from eqloom.sources import html as H
from eqloom.sources.durable import keep


@pytest.fixture()
def t(spark, sf):
    return K.analyse(papers.pages(spark, sf).where("id < 20"), "id", "html")


def test_only_what_is_asked_for(t):
    assert t["symbols"].count() > 0
    assert "chunks" in t and not {"meanings", "relations", "xrefs", "audit"} & set(t)


def test_meanings_need_neither_symbols_nor_relations(t):
    assert K.audit(t, ("meanings",)).where("key <> 'meaning'").count() == 0
    assert not {"symbols", "relations", "xrefs"} & set(t)


def test_tables_are_the_same_in_any_order(spark, sf):
    pages = papers.pages(spark, sf).where("id < 20")
    a, b = K.analyse(pages, "id", "html"), K.analyse(pages, "id", "html")
    names = ["symbols", "meanings", "relations"]
    for n in names:
        a[n]  # one search each
    for n in reversed(names):
        b[n]  # one search
    for n in names:
        rows = lambda d: sorted(map(str, d.select(*[F.round(c, 6).alias(c) if k == "double" else c for c, k in d.dtypes]).collect()))
        assert rows(a[n]) == rows(b[n])


def test_a_copy_replaces_a_table_for_itself_alone(t):
    c = t.copy()
    c["equations"] = c["equations"].where("eq_num = '1'")
    assert c["equations"].count() < t["equations"].count()
    assert K.audit(c, ("meanings",)).count() == t["equations"].count()


def test_capped_rows_hold_all_that_the_first_numbers_need(spark, sf):
    pages = [(r.id, r.html) for r in papers.pages(spark, sf).limit(60).collect()]
    assert any(sum(x[1] == "equation" for x in H.rows(i, h)) > 7 for i, h in pages)
    for i, h in pages:
        every, some = ([x for x in H.rows(i, h, D.PARTS, cap)] for cap in (None, 7))
        number = H.SCHEMA.split(", ").index("number string")
        first = list({x[number]: x for x in reversed(every) if x[1] == "equation"}.values())
        first = sorted(first, key=lambda x: x[2])[:7]
        assert [x for x in some if x[1] == "equation"] == first
        known = {x[number] for x in first}
        assert [x for x in some if x[1] != "equation" and (x[1] != "spot" or x[number] in known)] == [x for x in every if x[1] != "equation" and (x[1] != "spot" or x[number] in known)]
        assert [x[: number + 1] for x in some if x[1] == "spot"] == [x[: number + 1] for x in every if x[1] == "spot"]


def test_repeated_numbers_take_no_place():
    page = "".join(f'<table class="ltx_equation ltx_eqn_table"><tr><td><math alttext="x_{i}"></math></td><td><span class="ltx_tag ltx_tag_equation">({n})</span></td></tr></table>' for i, n in enumerate([1, 1, 2, 1, 3, 4]))
    got = [r[8] for r in H.rows(1, page, frozenset({"equation"}), 3)]
    assert got == ["x_0", "x_2", "x_4"]


def test_later_formulas_choose_among_as_many_sentences_as_they_need(spark):
    names = "id long, eq_num string, eq_ord int"
    eqs = spark.createDataFrame([(1, str(k), k - 3) for k in range(1, 5)], names)  # places need not begin at 1
    cands = [(1, str(k), 10 - i, 1.0, i, 0, f"s{i}", "c", 0, ["eq_num"]) for k in range(1, 5) for i in range(9)]
    scored = spark.createDataFrame(cands, "id long, eq_num string, points int, score double, rank int, pos int, s string, chunk_id string, char_offset int, signals array<string>")
    assert sorted((r.eq_num, r.meaning) for r in M.choose(scored, eqs).collect()) == [(str(k), f"s{k - 1}") for k in range(1, 5)]


def test_kept_tables_leave_no_shuffle_files(spark):
    def files():
        return sum(len(list(Path(d).rglob("shuffle_*.data"))) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    before = files()
    keep(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "few")
    assert files() <= before


def test_passages_are_numbered_without_a_shuffle_of_their_own(spark, sf, monkeypatch):
    """A paper's paragraphs come together once; no table of paragraphs is written, and no passage is sorted among all."""
    nodes = H.nodes(papers.pages(spark, sf).where("id < 20"), "id", "html", D.PARTS, D.CAP)
    eqs, kept = keep(D.equations(nodes), "equations"), {}
    monkeypatch.setattr(D, "keep", lambda df, tag: kept.setdefault(tag, df))
    D.passages(nodes, eqs)
    assert list(kept) == ["chunks"]
    assert "Window" not in kept["chunks"]._jdf.queryExecution().optimizedPlan().toString()


def test_passages_of_odd_papers(spark):
    """Repeated paragraph ids, numbers in any order, a repeated number, a table beside no formula, an empty paragraph, a null section."""
    names = "id long, kind string, ord int, elem_id string, para_id string, section_id string, text string, method string, number string, before string, after string, title string"
    row = lambda kind, at, para, text=None, number=None, method=None, sec="S1", before=None, after=None, title=None: (1, kind, at, None, para, sec, text, method, number, before, after, title)
    spot = lambda at, para, number, before="", after="", **how: row("spot", at, para, number=number, method="child", before=before, after=after, **how)
    nodes = [row("para", 5, "p2", "Second one here. Another follows it."), row("para", 1, "p1", "First of them all.", title="T"), row("para", 7, "p1", ""), row("para", 9, "p1", "Short. Third with a repeated id.", sec=None)]
    nodes += [spot(6, "p2", "10", "It is said."), spot(2, "p1", "9", "So it was.", title="T"), spot(3, "p1", "9", "Not this."), spot(4, "p1", "A.1", "Odd number."), spot(8, None, "3", "Nowhere."), spot(11, "p2", "77", "No formula.")]
    eqs = spark.createDataFrame([(1, n, i + 3, f"x_{n}") for i, n in enumerate(["10", "9", "A.1", "3"])], "id long, eq_num string, eq_ord int, equation string")
    got = D.passages(spark.createDataFrame(nodes, names), eqs).orderBy("chunk_ord").collect()
    assert [r.chunk_ord for r in got] == list(range(len(got)))
    p1, p2 = ["9", "A.1"], ["10", "77"]
    assert [(r.chunk_type[:4], r.text, r.para_id, r.section_id, r.eq_nums, r.char_offset) for r in got] == [
        ("sent", "First of them all.", "p1", "S1", p1, 0),
        ("sent", "Second one here.", "p2", "S1", p2, 0),
        ("sent", "Another follows it.", "p2", "S1", p2, 17),
        ("sent", "Third with a repeated id.", "p1", "", p1, 7),
        ("para", "First of them all.", "p1", "S1", p1, 0),
        ("para", "Second one here. Another follows it.", "p2", "S1", p2, 0),
        ("para", "Short. Third with a repeated id.", "p1", "", p1, 0),
        ("equa", "Nowhere. x_3", "", "S1", [], 0),
        ("equa", "T So it was. x_9", "p1", "S1", p1, 0),
        ("equa", "It is said. x_10", "p2", "S1", p2, 0),
        ("equa", "Odd number. x_A.1", "p1", "S1", p1, 0),
    ]
