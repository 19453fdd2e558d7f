"""Empty tables, null values, empty and long texts, and repeated rows through the core operators."""

import pytest
from pyspark.sql import functions as F

from eqloom.functions import text as T
from eqloom.operators import documents as D
from eqloom.operators import knowledge as K
from eqloom.operators import meaning as M
from eqloom.operators import quality as Q
from eqloom.operators import relations as E
from eqloom.operators import retrieval as R
from eqloom.sources import html as H
from eqloom.sources import papers as P

DOCS = "doc_id long, text string"


def test_text_functions(spark):
    d = spark.createDataFrame([(None,), ("",), (" \t\n",), (" A​b \\rho{x}_{0}",), ("word " * 50_000,)], "t string")
    c = F.col("t")
    r = d.select(T.clean_text(c).alias("a"), T.clean_context(c).alias("b"), T.is_prose(c).alias("p"), F.size(T.tokens(c)).alias("n"), F.size(T.sentences(c)).alias("s"), T.eq_number(c).alias("e"), T.has_cue(c).alias("q")).collect()
    assert [(x.a, x.b) for x in r[:4]] == [(None, None), ("", ""), ("", ""), ("Ab", "A​b")]
    assert [x.p for x in r] == [None, False, False, False, True]
    assert [x.n for x in r][1:] == [0, 0, r[3].n, 50_000] and r[4].a == ("word " * 50_000).strip()
    assert r[0].e is None and r[1].e is None and r[1].q is False


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, ""), (1, "alpha beta"), (None, "alpha gamma"), (4, "the of and")], DOCS)
    ask = spark.createDataFrame([(7, "alpha alpha"), (8, None), (9, "the")], "item_id long, text string")
    got = R.bm25(ask, docs)
    assert {(x["qid"], x["id"]) for x in got.collect()} == {(7, 1)}
    assert tuple(R.corpus_stats(docs).first()) == (6, 1.0)
    assert [(x["qid"], x["id"]) for x in R.top_k(R.tfidf(ask, docs), 3).collect()] == [(7, 1)]
    none = docs.limit(0)
    assert R.bm25(ask, none).count() == 0 and R.bm25(ask.limit(0), docs).count() == 0 and R.tfidf(ask, none).count() == 0
    assert tuple(R.corpus_stats(none).first()) == (0, None) and R.term_df(R.postings(none)).count() == 0


def test_documents(spark):
    n = H.nodes(spark.createDataFrame([(1, None), (2, ""), (None, "<p>x"), (3, "<table")], "i long, h string"), "i", "h")
    e = D.equations(n)
    c = D.passages(n, e)
    assert n.count() == e.count() == c.count() == D.cross_references(n, c).count() == D.fragments(n).count() == D.methods(n).count() == D.places(c).count() == 0
    p = spark.createDataFrame([(1, None), (2, "S1.p1"), (3, "S1.p2"), (4, "S1.p2"), (5, "odd"), (6, "")], "i long, para_id string")
    assert sorted((x["i"], x["i_b"]) for x in D.next_to(p, p).collect()) == [(2, 3), (2, 4), (3, 2), (4, 2)]
    assert D.running_before(spark.createDataFrame([], "o long, v long"), "o", "v").count() == 0
    assert D.until(spark.createDataFrame([(1, 1), (2, 2)], "id long, ord long"), e).count() == 2
    ids = spark.createDataFrame([(None, 1), ("", 2), (" arXiv:x ", 3), ("x", 4)], "t string, o long")
    assert [tuple(r) for r in P.numbered_papers(ids, F.col("t"), "o").collect()] == [("x", 3)]


def test_choices_and_relations(spark):
    e = spark.createDataFrame([(1, "1", 1, "", "", ""), (1, "2", 2, "x", "See (1).", "")], "id long, eq_num string, eq_ord int, equation string, before string, after string")
    got = {r.eq_num: (r.meaning, r.strategy) for r in M.cascade(e).collect()}
    assert got == {"1": ("", None), "2": ("", None)}  # too short to be a sentence
    assert M.cascade(e.limit(0)).count() == 0
    t = spark.createDataFrame([(1, "1", None), (1, "2", ""), (1, "3", "same words here"), (1, "4", "same words here"), (2, "1", "alone words")], "id long, eq_num string, text string")
    assert {(r.a, r.b, round(r.cosine, 6)) for r in E.cosines(t).collect()} == {("3", "4", 1.0), ("4", "3", 1.0)}
    assert [(r.a, r.b) for r in E.cites(e).collect()] == [("2", "1")] and E.pairs(e.limit(1)).count() == 0


@pytest.fixture(scope="module")
def nothing(spark):
    return K.analyse(spark.createDataFrame([], "i long, h string"), "i", "h")


def test_an_analysis_of_nothing(spark, nothing):
    assert all(t.count() == 0 for t in nothing.values()) and K.to_document(K.entries(nothing)).count() == 0
    assert {(r.metric, r.n, r.total, r.share) for r in Q.coverage(nothing).collect()} == {(m, 0, 0, None) for m in ("papers_empty", "equations", "meaning_empty", "symbols_empty", "relations_all_none", "meaning_noise", "pairs_related", "symbols_garbage")}
    assert Q.grades(nothing["relations"]).count() == Q.histogram(nothing["papers"], nothing["equations"]).count() == Q.strategies(nothing["audit"]).count() == 0
    assert tuple(Q.relation_validity(nothing["relations"], nothing["equations"], K.GRADES).first()) == (0, 0, 0)


def test_entries_that_are_no_objects(spark):
    texts = spark.createDataFrame([('{"p": {}}',), ("no json",), (None,), ('{"q": {"1": {"symbols": null, "relations": null, "audit-trail": null}}}',)], "value string")
    e = K.read_document(texts)
    assert {(r.paper, r.eq_num) for r in e.collect()} == {("p", None), ("q", "1")}
    assert {r.problem for r in K.violations(e).collect()} >= {"missing field equation", "missing field meaning"}
    assert Q.formats(e).first().verdict == "PASS"
