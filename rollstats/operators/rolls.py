"""Counts, frequencies and transitions of rolls(die_id, seq, side); every operator takes all dice at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_die():
    """The window of one die."""
    return Window.partitionBy("die_id")


def label_counts(rolls: DataFrame) -> DataFrame:
    """``(die_id, side, n)`` of the sides that came up. Counted before the shuffle, so a hot die costs its sides."""
    return rolls.groupBy("die_id", "side").agg(F.count(F.lit(1)).alias("n"))


def relative(counts: DataFrame) -> DataFrame:
    """Adds ``p``: each side's share of its die's rolls."""
    return counts.withColumn("p", F.col("n") / F.sum("n").over(by_die()))


def normalized(counts: DataFrame) -> DataFrame:
    """Adds ``freq``: each count over the mean count of the sides that came up."""
    return counts.withColumn("freq", F.col("n") / F.avg("n").over(by_die()))


def dense_counts(rolls: DataFrame, most: int) -> DataFrame:
    """Counts for every side from 0 to ``most`` at least, 0 where none came up.

    Sides are held in a map while the gaps are filled, one small row a die.
    """
    counted = label_counts(rolls).groupBy("die_id").agg(
        F.map_from_entries(F.collect_list(F.struct("side", "n"))).alias("at"), F.greatest(F.max("side"), F.lit(most)).alias("top")
    )
    return counted.select("die_id", "at", F.explode(F.sequence(F.lit(0), "top")).alias("side")).select(
        "die_id", "side", F.coalesce(F.element_at("at", F.col("side")), F.lit(0).cast("long")).alias("n")
    )


#: Parts in which the rows of one key are ranked before they meet.
PARTS = 64


def first_ranked(rows: DataFrame, keys: list[str], order: list, most: int, spread: str) -> DataFrame:
    """The first ``most`` rows of each key in ``order``, with their ``rank``.

    Each key is ranked in ``PARTS`` parts by a hash of the ``spread`` column first, and at most
    ``PARTS * most`` rows of a key meet in one task, however many it has.
    """
    parted = rows.withColumn("part", F.pmod(F.xxhash64(spread), F.lit(PARTS)))
    for by in ([*keys, "part"], keys):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        parted = parted.withColumn("rank", rank).where(F.col("rank") <= most)
    return parted.drop("part")


def prefixes(rolls: DataFrame, sizes: list[int]) -> DataFrame:
    """``(die_id, size, seq, side)``: the first N rolls of each die for each N, as N copies at most."""
    first = first_ranked(rolls, ["die_id"], ["seq"], max(sizes), "seq")
    wanted = F.filter(F.array(*(F.lit(s) for s in sorted(sizes))), lambda s: F.col("rank") <= s)
    return first.select("die_id", F.explode(wanted).alias("size"), "seq", "side")


def prefix_histogram(rolls: DataFrame, sizes: list[int]) -> DataFrame:
    counts = prefixes(rolls, sizes).groupBy("die_id", "size", "side").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("die_id", "size")))


def transitions(rolls: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """``(die_id, from_side, to_side, n)`` of consecutive rolls.

    A die's rolls are cut by sequence number into chunks, so no task needs a
    whole die; the steps from chunk to chunk come from the chunks' ends, a
    table as long as there are chunks.  ``seq`` is distinct within a die.
    """
    cut = rolls.where("side is not null").withColumn("chunk", F.floor(F.col("seq") / chunk))
    inside = Window.partitionBy("die_id", "chunk").orderBy("seq")
    steps = cut.select("die_id", F.lag("side").over(inside).alias("from_side"), F.col("side").alias("to_side"))
    ends = cut.groupBy("die_id", "chunk").agg(F.min_by("side", "seq").alias("first"), F.max_by("side", "seq").alias("last"))
    between = ends.select("die_id", F.lag("last").over(by_die().orderBy("chunk")).alias("from_side"), F.col("first").alias("to_side"))
    both = steps.union(between).where("from_side is not null")
    return both.groupBy("die_id", "from_side", "to_side").agg(F.count(F.lit(1)).alias("n"))


def dense_transitions(rolls: DataFrame) -> DataFrame:
    """The matrix over the sides 1 to the die's largest, with zeros."""
    seen = transitions(rolls).withColumn("key", F.struct("from_side", "to_side"))
    cells = seen.groupBy("die_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("at"))
    tops = rolls.groupBy("die_id").agg(F.max("side").alias("top"))
    grid = tops.join(cells, "die_id", "left").withColumn("from_side", F.explode(F.sequence(F.lit(1), "top")))
    grid = grid.withColumn("to_side", F.explode(F.sequence(F.lit(1), "top")))
    n = F.try_element_at("at", F.struct("from_side", "to_side"))
    return grid.select("die_id", "from_side", "to_side", F.coalesce(n, F.lit(0).cast("long")).alias("n"))
