"""Connected components of an edge table, distributed.

Alternating large-star and small-star rounds (Kiveris et al., "Connected
components in MapReduce and beyond", 2014).  Every round is two aggregations
with map-side combine and two joins on the hub column, where one side holds one
row a key: a hub with a third of all edges is split by Spark's skew join.
Nothing but two numbers a round comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import stored


def _state(edges: DataFrame) -> tuple:
    """Row count and an order-free digest of the edges: equal when a round changed nothing."""
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least node around it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("low"))
    return (
        both.where(F.col("b") > F.col("a"))
        .join(least, F.col("a") == F.col("hub"))
        .select(F.col("b").alias("a"), F.least("low", "hub").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, are linked to the least of them."""
    least = edges.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("low"))
    joined = edges.join(least, F.col("a") == F.col("hub"))
    below = joined.where(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    return below.union(least.select(F.col("hub").alias("a"), F.col("low").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of orderable ids to ``(node, component)``.

    ``component`` is the smallest id reachable from ``node``.  Only nodes with
    at least one edge to another node appear; loops and repeated edges do not
    matter.  No edges give no rows.
    """
    at = stored(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = _state(at)
    while before[0]:
        at = stored(_small_star(_large_star(at)))
        after = _state(at)
        if after == before:
            break
        before = after
    roots = at.select(F.col("b").alias("node")).distinct()
    return at.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
