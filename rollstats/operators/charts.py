"""Chart data: series of charts, bounds, fair lines, custom rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series(charts: DataFrame) -> DataFrame:
    """``(chart_id, pos, data_id)`` of ``charts(chart_id, data_ids, ...)``."""
    return charts.select("chart_id", F.posexplode("data_ids").alias("pos", "data_id"))


def missing_data(charts: DataFrame, histograms: DataFrame) -> DataFrame:
    """Series that no histogram belongs to."""
    return series(charts).join(histograms.select("data_id").distinct(), "data_id", "left_anti")


def lookup(charts: DataFrame, histograms: DataFrame) -> DataFrame:
    """Each chart's series with their histogram rows; raises if a series has none."""
    if gone := [r.data_id for r in missing_data(charts, histograms).select("data_id").distinct().orderBy("data_id").limit(20).collect()]:
        raise ValueError(f"no data for {', '.join(gone)}")
    return series(charts).join(histograms, "data_id")


def by_position(rows: DataFrame) -> DataFrame:
    """Series side by side: one row a place in the series, with the place as its label and p of every series."""
    at = F.row_number().over(Window.partitionBy("chart_id", "pos").orderBy("side"))
    return rows.withColumn("place", at).groupBy("chart_id", "place").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda s: s["p"]).alias("ps")
    )


def chart_max(rows: DataFrame) -> DataFrame:
    return rows.groupBy("chart_id").agg(F.max("ci_high").alias("max_y"))


def fair_values(charts: DataFrame, rows: DataFrame) -> DataFrame:
    """The chart's own fair value, unless missing or 0; else 1 over the sides of its first series."""
    first = rows.where("pos = 0").groupBy("chart_id").agg((1 / F.count(F.lit(1))).alias("first_fair"))
    own = F.when(F.col("fair_value") != 0, F.col("fair_value"))
    return charts.select("chart_id", "fair_value").join(first, "chart_id").select("chart_id", F.coalesce(own, "first_fair").alias("fair"))


def with_custom_rows(histogram: DataFrame, custom: DataFrame) -> DataFrame:
    """Synthetic rows before real ones."""
    return custom.unionByName(histogram)


def first_wins(tables: list[DataFrame], key: str = "data_id") -> DataFrame:
    """The union of tables, where an earlier table's ids hide later rows of the same id."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t.join(out.select(key).distinct(), key, "left_anti"))
    return out


def name_mismatches(charts: DataFrame) -> DataFrame:
    """Charts whose list of names is not as long as their list of series."""
    return charts.where(F.col("names").isNotNull() & (F.size("names") != F.size("data_ids"))).select("chart_id")


# The published charts' measures in pixels.
HEIGHT, LEGEND_X, LEGEND_Y, LEGEND_STEP = 220, 30, 30, 20


def geometry(n_series: Column) -> Column:
    """``struct(bar_width, bar_margin, group_width)`` in pixels by the number of series."""
    width, margin = F.when(n_series > 4, 6).otherwise(12), F.when(n_series > 1, 1).otherwise(3)
    group = F.when(n_series > 1, (n_series + 2) * (width + margin)).otherwise(width + margin)
    return F.struct(width.alias("bar_width"), margin.alias("bar_margin"), group.cast("int").alias("group_width"))


def bars(charts: DataFrame, rows: DataFrame) -> DataFrame:
    """``(chart_id, pos, side, x, y, width, height, whisker_x, low_y, high_y, fair_y, verdict, off)``: what is drawn of each bar, and by how many percent it is off.

    Bars stand side by side in a group a side, from the fair line up or down; y grows downwards.
    """
    sizes = charts.select("chart_id", geometry(F.size("data_ids")).alias("g"))
    scale = chart_max(rows).join(fair_values(charts, rows), "chart_id").join(sizes, "chart_id")
    place = F.row_number().over(Window.partitionBy("chart_id", "pos").orderBy("side")) - 1
    at = rows.withColumn("place", place).join(scale, "chart_id")
    y = lambda v: HEIGHT * (1 - v / F.col("max_y"))
    width, margin = F.col("g.bar_width"), F.col("g.bar_margin")
    x = F.col("place") * F.col("g.group_width") + 2 * margin + width * F.col("pos") + (F.col("pos") + 1) * margin
    off = 100 * (F.col("p") - F.col("fair")) / F.col("fair")
    # The wording and the limit of the published charts.
    text = (
        F.when(F.abs(F.col("p") - F.col("fair")) < 0.001, F.format_string("%d is within %.1f%% of.", "side", F.abs(off)))
        .when(off > 0, F.format_string("%d is %.1f%% more frequent than fair.", "side", off))
        .otherwise(F.format_string("%d is %.1f%% less frequent than fair.", "side", -off))
    )
    return at.select(
        "chart_id", "pos", "side", x.alias("x"), y(F.greatest("p", "fair")).alias("y"), width.alias("width"),
        F.abs(y(F.col("fair")) - y(F.col("p"))).alias("height"), (x + width / 2).alias("whisker_x"),
        y(F.col("ci_low")).alias("low_y"), y(F.col("ci_high")).alias("high_y"), y(F.col("fair")).alias("fair_y"), text.alias("verdict"), off.alias("off"),
    )


def legends(charts: DataFrame, rows: DataFrame) -> DataFrame:
    """``(chart_id, pos, name, x, y)`` of the charts with names: beside the bars, one below the other."""
    sides = rows.where("pos = 0").groupBy("chart_id").agg(F.count(F.lit(1)).alias("sides"))
    named = charts.where("names is not null").join(sides, "chart_id")
    x = F.col("sides") * geometry(F.size("data_ids"))["group_width"] + LEGEND_X
    each = named.select("chart_id", x.alias("x"), F.posexplode("names").alias("pos", "name"))
    return each.select("chart_id", "pos", "name", "x", (LEGEND_Y + LEGEND_STEP * F.col("pos")).alias("y"))


def records(histogram: DataFrame) -> DataFrame:
    """``(die_id, json)``: each die's rows as a JSON array of records, by side."""
    row = F.struct("side", "p", "ci_low", "ci_high")
    return histogram.groupBy("die_id").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("json"))


def from_records(json: DataFrame) -> DataFrame:
    """The rows of :func:`records`, with their ``place`` in the array."""
    rows = F.posexplode(F.from_json("json", "array<struct<side:int,p:double,ci_low:double,ci_high:double>>")).alias("place", "r")
    return json.select("die_id", rows).select("die_id", "place", "r.*")
