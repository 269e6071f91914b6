"""Labels onto groups of files, and the label sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import stored
from .ordered import RANGE_ROWS, running_total


def assign_labels(groups: DataFrame, labels: DataFrame, repeat: int | None = None) -> DataFrame:
    """``groups(group_idx, file)`` with the label of the same position, from ``labels(group_idx, label)``.

    With ``repeat``, groups past the last label get that label.  Raises where the
    numbers of groups and labels don't agree (too few without ``repeat``; too many;
    as many as groups with it).
    """
    n_groups = groups.select("group_idx").distinct().count()
    n_labels = labels.count()
    if repeat is None and n_groups != n_labels:
        raise ValueError(f"{n_groups} groups but {n_labels} labels")
    if repeat is not None and n_labels >= n_groups:
        raise ValueError(f"nothing to repeat: {n_groups} groups, {n_labels} labels")
    label = F.col("label") if repeat is None else F.coalesce("label", F.lit(repeat))
    return groups.join(labels, "group_idx", "left" if repeat is not None else "inner").withColumn("label", label)


def files_by_label(labelled: DataFrame) -> DataFrame:
    """Each file once per label."""
    return labelled.select("label", "file").distinct()


def missing_labels(labelled: DataFrame) -> DataFrame:
    """Labels from 1 to the largest that no file has."""
    seen = labelled.agg(F.max("label").alias("top"), F.collect_set("label").alias("seen"))
    return seen.select(F.explode(F.array_except(F.sequence(F.lit(1), "top"), "seen")).alias("label"))


def label_sequence(labelled: DataFrame, die_col: str | None = None) -> DataFrame:
    """``(seq, label)``: labels in the order of files, ties by label; a file under two labels rolls twice.

    Per die if ``die_col`` names a column.  Rows are sorted over all tasks, and numbered
    from the number of rows before them: no task needs a whole die.  ``seq`` is a long.
    """
    keys = [die_col] if die_col else []
    named = stored(labelled.select(*keys, "label", "file"))
    # Repeats meet in parts by the number of rows, so that no task holds more than a part.
    parts = 1 + named.count() // RANGE_ROWS
    pairs = named.repartition(parts, *keys, "label", "file").distinct()
    before = running_total(pairs, keys, ["file", "label"], F.lit(1).cast("long"), "before")
    return before.select(*keys, (F.col("before") + 1).alias("seq"), "label")


def skip_existing(files: DataFrame, done: DataFrame, force: bool = False, number: int | None = None) -> DataFrame:
    """Files whose output doesn't exist yet (all with ``force``), the first ``number`` by name if given."""
    left = files if force else files.join(done.select("file"), "file", "left_anti")
    return left.orderBy("file").limit(number) if number else left


def not_found_files(results: DataFrame) -> DataFrame:
    """``(file, not_found)``: the files without a result, and why; what a run lists at its end."""
    return results.where(~F.col("skipped") & F.col("not_found").isNotNull()).select("file", "not_found")


def run_tallies(results: DataFrame) -> DataFrame:
    """Files by outcome: processed, skipped or not found (``results(file, skipped, not_found)``)."""
    status = F.when(F.col("skipped"), "skipped").when(F.col("not_found").isNotNull(), "not found").otherwise("processed")
    return results.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("first"), F.max("file").alias("last"))
