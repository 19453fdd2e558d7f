import pytest

from eqloom.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, sf, duck, same, name):
    same(catalogue.QUERIES[name](spark, sf), duck, catalogue.ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["qid", "rank", "doc_id", "score"]
    assert set(e.oracle_sql()) <= set(e.queries())
