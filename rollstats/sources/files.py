"""Readers of labels, histograms, groupings, chart indices and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import stored
from ..operators.ordered import running_total

HISTOGRAM = "side int, p double, ci_low double, ci_high double"


def _die(path) -> F.Column:
    """The folder that holds the file."""
    return F.element_at(F.split(path, "/"), -2)


def parse_labels(files: DataFrame, num_labels: int | None = None) -> DataFrame:
    """``(die_id, seq, side)`` from ``files(die_id, value)``, whole files of one label a line.

    Lines that start with ``#`` are comments.  Any other line must be an integer,
    blank ones included, else the cast fails.  One end of line at the end is no line.
    ``num_labels`` takes that many from the start (a negative one drops from the end).
    """
    body = F.regexp_replace("value", r"\r?\n\z", "")
    lines = F.filter(F.split(body, "\n"), lambda x: ~x.startswith("#"))
    lines = F.when(body == "", F.array().cast("array<string>")).otherwise(lines)
    if num_labels is not None:
        keep = F.lit(num_labels) if num_labels >= 0 else F.greatest(F.size("lines") + num_labels, F.lit(0))
        return _numbered(files.withColumn("lines", lines).withColumn("lines", F.slice("lines", 1, keep)))
    return _numbered(files.withColumn("lines", lines))


def _numbered(files: DataFrame) -> DataFrame:
    rows = files.select("die_id", F.posexplode("lines").alias("pos", "line"))
    return rows.select("die_id", (F.col("pos") + 1).cast("bigint").alias("seq"), F.trim("line").cast("int").alias("side"))


def numbered_lines(spark: SparkSession, pattern: str, keep: Column | None = None) -> DataFrame:
    """``(die_id, at, line)``: the lines of text files in order, numbered from 0 a die; the folder is the die.

    Files are read in splits, many tasks a file.  A line's number is its place in its
    split and the lines of the splits before, by file name and offset: a running total over a
    table of a row a split.  Only lines that pass ``keep``, a condition on ``value``, count.  Empty files
    and files of other lines only give no rows.  Parts of one die are read in the order of their names.
    """
    path = F.col("_metadata.file_path")
    lines = spark.read.text(pattern).select(_die(path).alias("die_id"), path.alias("_path"), F.col("_metadata.file_block_start").alias("_from"), F.col("value").alias("line"))
    if keep is not None:
        lines = lines.where(keep)
    # Written once, so that places in splits are the same in every later job; a task's ids count its rows in order.
    placed = stored(lines.withColumn("_id", F.monotonically_increasing_id()))
    split = ["die_id", "_path", "_from"]
    splits = placed.groupBy(*split).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    splits = running_total(splits, ["die_id"], ["_path", "_from"], F.col("_n"), "_before")
    return placed.join(splits.drop("_n"), split).select("die_id", (F.col("_before") + F.col("_id") - F.col("_first")).alias("at"), "line")


def read_labels(spark: SparkSession, pattern: str, num_labels: int | None = None) -> DataFrame:
    """``(die_id, seq, side)`` of all label files that match ``pattern``, e.g. ``data/*/labels.csv``; the folder is the die.

    The same rows as :func:`parse_labels` gives for whole files, for files of any size.
    """
    lines = numbered_lines(spark, pattern, ~F.col("line").startswith("#"))
    if num_labels is not None and num_labels >= 0:
        lines = lines.where(F.col("at") < num_labels)
    elif num_labels is not None:
        sizes = lines.groupBy("die_id").agg((F.max("at") + 1 + num_labels).alias("_end"))
        lines = lines.join(sizes, "die_id").where(F.col("at") < F.col("_end"))
    return lines.select("die_id", (F.col("at") + 1).alias("seq"), F.trim("line").cast("int").alias("side"))


def read_histograms(spark: SparkSession, pattern: str) -> DataFrame:
    """``(name, side, p, ci_low, ci_high)`` by position, whatever the header; of repeated sides the last counts."""
    rows = spark.read.schema(HISTOGRAM).option("enforceSchema", True).csv(pattern, header=True)
    path = F.col("_metadata.file_path")
    # A folder a die, as the writer makes them, names the die; else the file does.
    name = F.coalesce(F.nullif(F.regexp_extract(path, r"/die_id=([^/]*)/[^/]*$", 1), F.lit("")), F.regexp_extract(path, r"([^/]*)\.csv$", 1))
    # The order of lines: file, split, and the task's own order inside a split; splits are not dealt in order.
    at = F.struct(path.alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    named = rows.select(name.alias("name"), "*", at.alias("at"))
    last = named.groupBy("name", "side").agg(F.max_by(F.struct("p", "ci_low", "ci_high"), "at").alias("v"))
    return last.select("name", "side", "v.*")


def read_histogram_by_name(spark: SparkSession, path: str) -> DataFrame:
    """A histogram whose columns are found by their header names."""
    rows = spark.read.csv(path, header=True)
    return rows.select(*(F.col(c).cast(t).alias(c) for c, t in (x.split() for x in HISTOGRAM.split(", "))))


def read_groups(spark: SparkSession, pattern: str) -> DataFrame:
    """``(die_id, group_idx, member_idx, file)`` from JSON lists of lists; member 0 stands for its group."""
    return parse_groups(spark.read.text(pattern, wholetext=True).select(_die(F.col("_metadata.file_path")).alias("die_id"), "value"))


def read_group_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """``(die_id, group_idx, member_idx, file)`` from groupings with a member a line, as the writer makes them.

    A line is a name as JSON between the brackets of its group; a group's number is the number of groups that
    begin before it, and a member's the lines since its group began.  Groups may have any number of members.
    """
    lines = numbered_lines(spark, pattern)
    begins = F.col("line").startswith("[")
    lines = lines.withColumns({"_begins": begins, "line": F.regexp_replace(F.regexp_replace("line", r"^\[+", ""), r"\]*,?$", "")})
    lines = running_total(lines, ["die_id"], ["at"], F.col("_begins").cast("long"), "_groups")
    lines = lines.withColumn("group_idx", F.col("_groups") + F.col("_begins").cast("long") - 1)
    starts = lines.where("_begins").select("die_id", "group_idx", F.col("at").alias("_start"))
    file = F.get(F.from_json(F.concat(F.lit("["), "line", F.lit("]")), "array<string>"), F.lit(0))
    return lines.join(starts, ["die_id", "group_idx"]).select(
        "die_id", F.col("group_idx").cast("int"), (F.col("at") - F.col("_start")).cast("int").alias("member_idx"), file.alias("file")
    )


def parse_groups(text: DataFrame) -> DataFrame:
    """``(die_id, group_idx, member_idx, file)`` from ``text(die_id, value)``."""
    lists = text.select("die_id", F.posexplode(F.from_json("value", "array<array<string>>")).alias("group_idx", "members"))
    return lists.select("die_id", "group_idx", F.posexplode("members").alias("member_idx", "file"))


def read_chart_index(spark: SparkSession, path: str) -> DataFrame:
    """``(chart_id, title, names, filenames, fairValue)`` from a JSON object by chart id."""
    return parse_chart_index(spark.read.text(path, wholetext=True))


def parse_chart_index(text: DataFrame) -> DataFrame:
    """``(chart_id, title, names, filenames, fairValue)`` from ``text(value)``."""
    entry = "struct<title:string,names:array<string>,filenames:array<string>,fairValue:double>"
    return text.select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("chart_id", "c")).select("chart_id", "c.*")


def list_images(spark: SparkSession, folder: str, reference: str | None = None) -> DataFrame:
    """``file`` names that end in jpg in any case, but for the reference image; contents are not read."""
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file"))
    return image_names(files, reference)


def image_names(files: DataFrame, reference: str | None = None) -> DataFrame:
    """Of ``files(file)`` those that end in jpg in any case, but for the reference image."""
    kept = files.where(F.lower("file").endswith("jpg"))
    return kept.where(F.lower("file") != reference.lower()) if reference else kept


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded images as ``(file, width, height, channels, data)``."""
    images = spark.read.format("image").option("dropInvalid", True).load(folder)
    return images.select(
        F.regexp_extract("image.origin", r"([^/]*)$", 1).alias("file"), F.col("image.width").alias("width"), F.col("image.height").alias("height"),
        F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"),
    )


def catalogue(folders: DataFrame, labelled: DataFrame) -> DataFrame:
    """``(die_id, message)`` of ``folders(die_id)``: what a run says of each; folders without labels are named, not skipped silently."""
    has = labelled.select("die_id").distinct().withColumn("has", F.lit(True))
    return folders.join(has, "die_id", "left").select("die_id", F.when(F.col("has"), "labels found").otherwise("no labels").alias("message"))


DIAMETERS = ("side", "opp", "mm", "dd", "pside", "popp")


def parse_diameters(text: DataFrame) -> DataFrame:
    """``(die_id, side, opp, mm, dd, pside, popp)`` from ``text(die_id, value)``: six rows of tab-separated numbers, then notes."""
    lines = F.slice(F.split("value", "\r?\n"), 1, len(DIAMETERS))
    cells = F.map_from_entries(F.transform(lines, lambda x: F.struct(F.split(x, "\t")[0].alias("k"), F.slice(F.split(x, "\t"), 2, 1000).alias("v"))))
    at = text.select("die_id", cells.alias("c"))
    columns = F.explode(F.arrays_zip(*(F.element_at("c", F.lit(k)).alias(k) for k in DIAMETERS))).alias("r")
    kind = lambda k: "int" if k in ("side", "opp") else "double"
    return at.select("die_id", columns).select("die_id", *(F.col(f"r.{k}").cast(kind(k)).alias(k) for k in DIAMETERS))


def read_diameters(spark: SparkSession, pattern: str) -> DataFrame:
    """All files of measured diameters that match ``pattern``; the folder is the die."""
    return parse_diameters(spark.read.text(pattern, wholetext=True).select(_die(F.col("_metadata.file_path")).alias("die_id"), "value"))
