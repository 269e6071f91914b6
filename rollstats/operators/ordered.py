"""Running totals over rows in order, without a task that needs a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import stored

#: Rows of a range, about: what one task sorts.
RANGE_ROWS = 1 << 18


def running_total(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows of the same key that come before in ``order``.

    Rows are sorted over all tasks, range by range; totals run inside a range, and from range
    to range over a table of a row a range and key.  Rows that agree in ``order`` come in any order.
    """
    held = stored(rows.withColumn("_value", value))
    # As many ranges as the rows ask for, by their number and not by their bytes, which say little of sorted rows in memory.
    ranges = 1 + held.count() // RANGE_ROWS
    # Written once: the ranges must be the same in every later job.
    ranged = stored(held.repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy(*keys, "_range").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*(F.col(c).alias(f"_of_{c}") for c in keys), F.col("_range").alias("_of_range"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    before = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.repartition(ranges, *keys, "_range").withColumn("_within", F.coalesce(F.sum("_value").over(before), F.lit(0)))
    # A null key joins like any other.
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys] + [F.col("_range") == F.col("_of_range")]
    return within.join(starts, same).select(*rows.columns, (F.col("_start") + F.col("_within")).alias(name))
