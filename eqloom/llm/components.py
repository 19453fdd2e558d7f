"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two aggregations with map-side combine and two joins, so a hub with a
third of all edges is summed before the shuffle and its join side can be split by AQE.
Each round is written to the shared folder; nothing but two counters reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eqloom.llm.common import discard, materialize


def _sums(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the least node id reachable.

    Rows are the nodes of edges between two different nodes; an isolated node has no row.
    Null ends are ignored.  An empty table gives an empty table.
    """
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    kept = e = materialize(e, "cc")
    before = _sums(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        # large star: each neighbour above u is tied to the least of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        big = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its lower neighbours are tied to the least of them
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        e = big.join(low, "u").select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        old, e = kept, materialize(e, "cc")
        kept = e
        discard(old)
        now = _sums(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
