import pytest

from eqloom.plans import papers


@pytest.mark.parametrize("name", sorted(papers.ORACLES))
def test_query_matches_sql(spark, sf, duck, same, name):
    """The queries of a session share one analysis."""
    same(papers.QUERIES[name](spark, sf), duck, papers.ORACLES[name])
