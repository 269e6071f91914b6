"""Fairness statistics, confidence intervals by resampling, and random subsamples."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import chi2_survival
from ..functions.storage import stored
from .ordered import running_total
from .rolls import first_ranked, label_counts, normalized, relative


#: Sides of a die whose histogram is sent to every task: 40 bytes each.
MAX_SIDES = 100_000


def summary_stats(rolls: DataFrame) -> DataFrame:
    """Per die: rolls, sides seen, spread and range of p, the fair share, and the expected value."""
    return relative(label_counts(rolls)).groupBy("die_id").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.stddev_pop("p").alias("stddev"), F.min("p").alias("min_p"),
        F.max("p").alias("max_p"), (1 / F.count(F.lit(1))).alias("fair"), F.sum(F.col("side") * F.col("p")).alias("expected"),
    )


def normalized_stddev(rolls: DataFrame) -> DataFrame:
    """Population deviation of the normalised frequencies: the measure of the published table of dice."""
    return normalized(label_counts(rolls)).groupBy("die_id").agg(F.stddev_pop("freq").alias("stddev"))


def chi_square(rolls: DataFrame) -> DataFrame:
    """Goodness of fit with equal shares over the sides that came up: statistic, dof, p."""
    expected = F.avg("n").over(Window.partitionBy("die_id"))
    terms = label_counts(rolls).withColumn("term", F.pow(F.col("n") - expected, 2) / expected)
    out = terms.groupBy("die_id").agg(F.sum("term").alias("statistic"), (F.count(F.lit(1)) - 1).alias("dof"))
    return out.withColumn("p", chi2_survival(F.col("statistic"), F.col("dof")))


def rolled_up(rolls: DataFrame, dice: DataFrame, levels: list[str]) -> DataFrame:
    """Fairness at every level of a hierarchy of ``dice(die_id, *levels)``, down to all dice: one row a group of the roll-up.

    ``(*levels, level, dice, n, statistic, dof, p, stddev)``: chi-square statistics of independent dice
    add up, as do their degrees of freedom; ``stddev`` is the mean over dice of the deviation of normalised frequencies.  ``level`` tells
    how many of the last levels are summed over; there these columns are null.  An extension: the dice are not
    compared by maker elsewhere.
    """
    per_die = chi_square(rolls).drop("p").join(normalized_stddev(rolls), "die_id").join(label_counts(rolls).groupBy("die_id").agg(F.sum("n").alias("n")), "die_id")
    named = per_die.join(dice.select("die_id", *levels), "die_id")
    sums = named.rollup(*levels).agg(
        F.grouping_id().alias("id"), F.count(F.lit(1)).alias("dice"), F.sum("n").alias("n"), F.sum("statistic").alias("statistic"), F.sum("dof").alias("dof"), F.avg("stddev").alias("stddev")
    )
    level = F.bit_count("id").cast("int").alias("level")
    return sums.select(*levels, level, "dice", "n", "statistic", "dof", chi2_survival(F.col("statistic"), F.col("dof")).alias("p"), "stddev")


#: Sides that are drawn together: resamples times so many numbers are in memory at once.
BLOCK_SIDES, BLOCK_NUMBERS = 512, 1 << 21


def _two_to(power: Column | str) -> Column:
    return F.pow(F.lit(2.0), power).cast("long")


def draw_blocks(counts: DataFrame, resamples: int) -> DataFrame:
    """``(die_id, side, n, block, path)``: each die's sides dealt by a hash into a power of two of blocks.

    ``path`` leads from all sides of the die to the block: one step a halving, ``(level, node, here, both)``, with the rolls of
    the half that the block is in and those of both halves.
    """
    most = max(1, min(BLOCK_SIDES, BLOCK_NUMBERS // resamples))
    levels = F.greatest(F.lit(0), F.ceil(F.log2(F.count(F.lit(1)) / most))).cast("int")
    depth = counts.groupBy("die_id").agg(levels.alias("depth"))
    dealt = stored(counts.join(depth, "die_id").withColumn("block", F.pmod(F.xxhash64("side"), _two_to("depth"))))
    sums = dealt.groupBy("die_id", "block", "depth").agg(F.sum("n").alias("n"))
    # A node of a level holds the blocks that agree in that many low bits.
    steps = sums.select("die_id", "block", "n", F.explode(F.sequence(F.lit(0), "depth")).alias("level"))
    nodes = steps.withColumn("node", F.pmod("block", _two_to("level"))).groupBy("die_id", "level", "node").agg(F.sum("n").alias("here"))
    above = nodes.select("die_id", (F.col("level") + 1).alias("level"), F.col("node").alias("parent"), F.col("here").alias("both"))
    halves = nodes.where("level > 0").withColumn("parent", F.pmod("node", _two_to(F.col("level") - 1))).join(above, ["die_id", "level", "parent"])
    blocks = sums.where("depth > 0").select("die_id", "block", F.explode(F.sequence(F.lit(1), "depth")).alias("level"))
    blocks = blocks.withColumn("node", F.pmod("block", _two_to("level"))).join(halves, ["die_id", "level", "node"])
    paths = blocks.groupBy("die_id", "block").agg(F.array_sort(F.collect_list(F.struct("level", "node", "here", "both"))).alias("path"))
    return dealt.select("die_id", "side", "n", "block").join(paths, ["die_id", "block"], "left")


def bootstrap(rolls: DataFrame, resamples: int = 1000, seed: int = 1) -> DataFrame:
    """``(die_id, side, p, ci_low, ci_high)``: 5th and 95th percentile over resamples.

    n draws with replacement are one multinomial draw of the counts, so a
    resample costs the sides and not the rolls.  A die's sides lie in blocks, a group of its own each.  How many draws of a
    resample fall into a block follows from halving: of a node's draws, a binomial number falls into its first
    half.  A node's numbers are seeded by die and node, so every block that passes it draws
    the same, and the result does not depend on how blocks are spread over tasks.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("side")
        counts, die = g["n"].to_numpy(), [ord(c) for c in str(g["die_id"].iloc[0])]
        path = g["path"].iloc[0]
        path = [] if path is None else list(path)
        total = int(path[0]["both"]) if path else int(counts.sum())
        draws = np.full(resamples, total)
        for step in path:
            level, node = int(step["level"]), int(step["node"])
            second = node >> (level - 1)  # 1 in the second half of the node above
            first = step["both"] - step["here"] if second else step["here"]
            numbers = np.random.default_rng([seed, level, node % (1 << (level - 1)), *die]).binomial(draws, first / step["both"])
            draws = draws - numbers if second else numbers
        rng = np.random.default_rng([seed, 0, int(g["block"].iloc[0]), *die])
        low, high = np.percentile(rng.multinomial(draws, counts / counts.sum()), [5, 95], axis=0) / total
        return pd.DataFrame({"die_id": g["die_id"], "side": g["side"], "p": counts / total, "ci_low": low, "ci_high": high})

    counts = stored(label_counts(rolls).select(F.col("die_id").cast("string"), F.col("side").cast("int"), "n"))
    blocks = draw_blocks(counts, resamples)
    return blocks.groupBy("die_id", "block").applyInPandas(run, "die_id string, side int, p double, ci_low double, ci_high double")


def hash_number(*parts: Column | str) -> Column:
    """A number below 2^32 from the joined parts; the same in any engine with md5."""
    text = F.concat_ws("-", *(p if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


#: Draws start in rows of so many rolls; a task makes, and another counts, about so many draws.
DRAW_CHUNK, TASK_DRAWS = 1 << 11, 1 << 21


def draw_counts(sizes: DataFrame, resamples: int, seed: str) -> DataFrame:
    """``(size, k, hits)``: how often each resample of ``size`` rolls draws roll ``k``, an array by resample; rolls that none draws are left out.

    Draws depend on the number of rolls only, so dice of one size share them.  Tasks get the same number
    of draws whatever the sizes are, and nothing multiplies behind a shuffle.
    """
    distinct = stored(sizes.select("size").distinct())
    tasks = 1 + (distinct.agg(F.sum("size")).first()[0] or 0) * resamples // TASK_DRAWS
    start = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(DRAW_CHUNK).cast("bigint")))
    chunks = distinct.select("size", start.alias("start")).repartition(tasks, "size", "start")
    draws = chunks.select("size", F.explode(F.sequence("start", F.least(F.col("start") + DRAW_CHUNK, "size") - 1)).alias("i"))
    draws = draws.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    k = F.pmod(hash_number(seed, F.col("b").cast("string"), F.col("i").cast("string")), F.col("size"))
    drawn = draws.select("size", k.alias("k"), "b").repartition(tasks, "size", "k")
    return drawn.groupBy("size", "k").agg(F.array(*(F.count_if(F.col("b") == b) for b in range(resamples))).alias("hits"))


def bootstrap_deterministic(rolls: DataFrame, resamples: int = 20, seed: str = "7") -> DataFrame:
    """The bootstrap with a hash as its random numbers, so that any engine can repeat it draw by draw.

    Draw i of resample b takes roll number md5(seed-b-i) mod n.  For checking; costs n draws a resample for each different n.
    A roll meets its hits in all resamples as one row, and dice are added up by side.
    """
    sizes = stored(rolls.groupBy("die_id").agg(F.count(F.lit(1)).alias("size")))
    ranked = running_total(rolls.select("die_id", "seq", "side"), ["die_id"], ["seq"], F.lit(1).cast("bigint"), "k").join(sizes, "die_id")
    # Spark can't tell how many rows come from few sizes: without the hint any number of them would be broadcast.
    drawn = ranked.select("die_id", "size", "k", "side").join(draw_counts(sizes, resamples, seed).hint("merge"), ["size", "k"])
    # A side that a resample missed counts 0 there.
    sums = [F.sum(F.get("hits", F.lit(b))) for b in range(resamples)]
    by_side = drawn.groupBy("die_id", "size", "side").agg(F.array_sort(F.array(*sums)).alias("all"))

    def at(q: float) -> Column:
        place = q * (resamples - 1)
        low, part = int(place), place - int(place)
        a, b = F.element_at("all", low + 1), F.element_at("all", min(low + 2, resamples))
        return a + (b - a) * part

    return by_side.select("die_id", "side", (at(0.05) / F.col("size")).alias("ci_low"), (at(0.95) / F.col("size")).alias("ci_high"))


#: Rows that a task holds before it passes them on; at most twice as many, and a batch, are held at once.
HELD = 1 << 17


def smallest_hashes(rolls: DataFrame, sizes: list[int], seed: str) -> DataFrame:
    """``(die_id, size, h, seq, side)``: of each die and size the ``size`` rolls with the smallest hashes, and few more.

    A task keeps a die's smallest so far for each size, and passes on no more of them: at most ``size``
    rows a die, size and task reach the shuffle, unless a task sees more dice than it can
    hold.  Such states merge in any order; whoever reads them takes the smallest again.
    """
    hashes = F.array(*(hash_number(seed, str(s), F.col("seq").cast("string")) for s in sizes))
    kinds = dict(rolls.dtypes)

    def cut(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["die_id", "size", "h", "seq"], kind="stable")
        return g[g.groupby(["die_id", "size"], sort=False, dropna=False).cumcount() < g["size"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = limit = 0
        for b in batches:
            h = np.stack(b["h"].to_numpy()) if len(b) else np.zeros((0, len(sizes)))
            for k, size in enumerate(sizes):
                held.append(cut(b[["die_id", "seq", "side"]].assign(size=size, h=h[:, k])))
                rows += len(held[-1])
            if rows > max(HELD, 2 * limit):
                held = [cut(pd.concat(held))]
                rows = limit = len(held[0])
                if rows > HELD:
                    yield held[0]
                    held, rows, limit = [], 0, 0
        if held:
            yield cut(pd.concat(held))

    schema = f"die_id {kinds['die_id']}, seq {kinds['seq']}, side {kinds['side']}, size int, h long"
    return rolls.select("die_id", "seq", "side", hashes.alias("h")).mapInPandas(run, schema)


def subsample_histogram(rolls: DataFrame, sizes: list[int], seed: str = "7") -> DataFrame:
    """Normalised histograms of random subsamples without replacement: ``(die_id, size, side, freq)``.

    Each size draws independently, the rolls with the smallest hashes (see :func:`smallest_hashes`).  Sides of the
    die that a subsample misses have 0; sizes beyond a die's rolls are left out.
    """
    enough = rolls.groupBy("die_id").agg(F.count(F.lit(1)).alias("rolls"), F.sort_array(F.collect_set("side")).alias("sides"))
    picked = first_ranked(smallest_hashes(rolls, sizes, seed), ["die_id", "size"], ["h", "seq"], max(sizes), "seq").where(F.col("rank") <= F.col("size"))
    counts = picked.groupBy("die_id", "size").agg(F.count(F.lit(1)).alias("m"), F.collect_list("side").alias("got"))
    counts = counts.join(enough, "die_id").where(F.col("size") <= F.col("rolls"))
    each = counts.select("die_id", "size", "m", "got", F.explode("sides").alias("side"))
    n = F.size(F.filter("got", lambda s: s == F.col("side")))
    return each.select("die_id", "size", "side", (n * F.size(F.array_distinct("got")) / F.col("m")).alias("freq"))


def combine(a: DataFrame, b: DataFrame) -> DataFrame:
    """Histogram of the sum of two dice: every product of p, and of the bounds, summed by the sum of sides.

    Histograms are as long as a die has sides; one of over ``MAX_SIDES`` is refused, as it is sent to every task.
    """
    if b.limit(MAX_SIDES + 1).count() > MAX_SIDES:
        raise ValueError(f"a histogram of over {MAX_SIDES} sides can't be combined")
    other = b.select(F.col("side").alias("side2"), F.col("p").alias("p2"), F.col("ci_low").alias("low2"), F.col("ci_high").alias("high2"))
    one = other.agg(F.collect_list(F.struct("*")).alias("all"))
    pairs = a.join(F.broadcast(one)).select("*", F.explode("all").alias("o"))
    return pairs.groupBy((F.col("side") + F.col("o.side2")).alias("side")).agg(
        F.sum(F.col("p") * F.col("o.p2")).alias("p"), F.sum(F.col("ci_low") * F.col("o.low2")).alias("ci_low"),
        F.sum(F.col("ci_high") * F.col("o.high2")).alias("ci_high"),
    )


def combine_all(histograms: list[DataFrame]) -> DataFrame:
    """The sum of any number of dice."""
    return reduce(combine, histograms)
