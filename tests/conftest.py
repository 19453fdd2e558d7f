import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.fixture(scope="session")
def same():
    """Compare a DataFrame with DuckDB rows, whatever their order."""

    def check(df, con, sql):
        rel = con.execute(sql)
        cols = [d[0] for d in rel.description]
        assert sorted(cols) == sorted(df.columns)
        show = lambda v: "null" if v is None else str(round(v, 6)) if isinstance(v, float) else str(v)
        theirs = sorted(tuple(show(v) for v in r) for r in rel.fetchall())
        ours = sorted(tuple(show(v) for v in r) for r in df.select(*cols).collect())
        assert ours == theirs

    return check
