"""Command line: python -m rollstats.cli COMMAND ...

Options are those of the tasks they drive; every command handles one folder or a pattern of many.
"""

from __future__ import annotations

import argparse
import re

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import scalars
from .functions.storage import stored
from .operators import charts, grouping, imaging, labeling, rolls, stats
from .operators.ordered import running_total
from .session import session
from .sources import files, sinks


def summarize(spark, args) -> None:
    """Chi-square, summary statistics and a text histogram of every die; optional CSV."""
    all_rolls = files.read_labels(spark, args.labels, args.num_labels)
    chi = stats.chi_square(all_rolls).join(stats.summary_stats(all_rolls), "die_id")
    histogram = stats.bootstrap(all_rolls, args.resamples).join(chi.select("die_id", "fair"), "die_id")
    lines = histogram.withColumn("line", scalars.histogram_line(*(F.col(c) for c in ("side", "p", "ci_low", "ci_high", "fair"))))
    bars = lines.groupBy("die_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("side", "line"))), lambda x: x["line"]), "\n").alias("bars"))
    for r in chi.join(bars, "die_id").orderBy("die_id").toLocalIterator():
        print(f"{r.die_id}: N={r.n} p={r.p:f} ({int(100 * r.p)}% chance the data is from a random source) stddev={r.stddev:.3f} min={r.min_p:.3f} max={r.max_p:.3f} fair={r.fair:.3f} expected={r.expected:.2f}\n{r.bars}")
    if args.csv:
        sinks.write_histograms(histogram.drop("fair"), args.csv)
    if args.sequence_graph:
        cells = rolls.dense_transitions(all_rolls)
        most = cells.groupBy("die_id").agg(F.max("n").alias("most"))
        grey = cells.join(most, "die_id").withColumn("grey", scalars.grey(F.col("n"), F.col("most"))).drop("most")
        grey.write.mode("overwrite").parquet(args.sequence_graph)


def combine(spark, args) -> None:
    """The distribution of the sum of dice, from their histogram files."""
    out = stats.combine_all([files.read_histograms(spark, f).drop("name") for f in args.histograms])
    for r in sinks.histogram_text(out).orderBy("side").collect():
        print(",".join(map(str, r)))


def label(spark, args) -> None:
    """Labels for the groups of one summary; writes the label sequence."""
    groups = files.read_groups(spark, args.summary_data)
    given = spark.createDataFrame(list(enumerate(args.values)), "group_idx int, label int")
    try:
        labelled = labeling.assign_labels(groups, given, args.repeat)
    except ValueError as e:
        # What the groups look like: the first four members of each, beside its label.
        few = groups.where("member_idx < 4").groupBy("group_idx").agg(F.array_join(F.array_sort(F.collect_list("file")), " ").alias("some"))
        for r in few.join(given, "group_idx", "left").orderBy("group_idx").toLocalIterator():
            print(f"{'-' if r.label is None else r.label}: {r.some}")
        raise SystemExit(str(e)) from None
    for r in labeling.missing_labels(labelled).orderBy("label").collect():
        print(f"no file has label {r.label}")
    sequence = labeling.label_sequence(labelled, "die_id")
    sinks.write_labels(sequence, args.labels, f"labels: {' '.join(map(str, args.values))}")


def crop(spark, args) -> None:
    """Finds the die in every new photo of a folder; writes boxes and squares, prints what was found."""
    named = files.list_images(spark, args.folder).where(F.lower("file") == args.reference.lower()).first()  # its name in any case
    reference = files.read_images(spark, f"{args.folder}/{named.file}").first() if named else None
    if reference is None:
        raise SystemExit(f"no reference photo {args.reference} in {args.folder}")
    photos = files.read_images(spark, args.folder)
    names = files.list_images(spark, args.folder, args.reference)
    try:
        done = spark.read.parquet(args.out).select("file")
    except AnalysisException:
        done = names.limit(0)
    todo = labeling.skip_existing(names, done, args.force, args.number)
    found = imaging.detect(
        photos.join(todo, "file"), (reference.width, reference.height, reference.channels, bytes(reference.data)),
        distance=2 * args.crop_size // 5 // args.resize, threshold=args.threshold, factor=args.resize,
    )
    found = stored(imaging.crop_bounds(found, reference.width, reference.height, args.crop_size))
    found.write.mode("overwrite" if args.force else "append").parquet(args.out)
    skipped = (names.limit(0) if args.force else names.join(done.select("file"), "file", "left_semi")).withColumns({"skipped": F.lit(True), "not_found": F.lit(None).cast("string")})
    results = skipped.unionByName(found.select("file", "not_found").withColumn("skipped", F.lit(False)))
    for r in labeling.run_tallies(results).orderBy("status").collect():
        print(f"{r.status}: {r.n}")
    for r in labeling.not_found_files(results).orderBy("file").toLocalIterator():
        print(f"not found in {r.file} @ threshold {args.threshold}: {r.not_found}")


def group(spark, args) -> None:
    """Groups photos: by their number of pips, or with --matches by the matches of their descriptors."""
    if args.matches:
        return group_matches(spark, args)

    def greys(batches):
        for b in batches:
            raw = [np.frombuffer(d, dtype=np.uint8).reshape(h, w, c)[..., :3].mean(axis=2).astype(np.uint8).tobytes() for d, w, h, c in zip(b["data"], b["width"], b["height"], b["channels"])]
            yield pd.DataFrame({"file": b["file"], "width": b["width"], "height": b["height"], "grey": raw})

    photos = files.read_images(spark, args.folder).mapInPandas(greys, "file string, width int, height int, grey binary")
    counted = stored(grouping.count_pips(photos))
    counted.write.mode("overwrite").parquet(args.out)
    for r in grouping.pip_groups(counted).orderBy(F.desc("size"), "rep").collect():
        print(f"{r.num_pips} pips: {r['size']} files, first {r.rep}")


def group_matches(spark, args) -> None:
    """Leaders and their members from candidates(item, leader, inliers, scale, features_a, features_b) of the folder's photos.

    Small groups move to the first large one that matches; groups are written largest first, a member a line, and at
    most ``--summary-max-members`` of each to the overview's tiles.
    """
    photos = files.list_images(spark, args.folder).select(F.col("file").alias("item"))
    complete = grouping.complete_matches(spark.read.parquet(args.matches), args.match_count_threshold, args.scale_threshold, args.feature_threshold)
    complete = stored(complete.select("item", F.col("leader").alias("other"), "inliers"))
    led = stored(grouping.leaders(photos, complete))
    best = complete.groupBy("item").agg(F.max("inliers").alias("match_count"))
    members = led.where("item != leader").join(best, "item", "left").select(F.col("leader").alias("rep"), F.col("item").alias("member"), "match_count")
    die = F.lit("summary").alias("die_id")
    groups = led.where("item = leader").select(F.col("item").alias("rep")).join(members, "rep", "left").select(die, "rep", "member", F.coalesce("match_count", F.lit(0)).alias("match_count"))
    moved = grouping.reparent(groups, complete.select(die, "item", "other")).select("rep", "new_rep")
    final = stored(led.join(moved, F.col("leader") == F.col("rep")).select(F.col("new_rep").alias("rep"), F.col("item").alias("file")))
    sizes = final.groupBy("rep").agg(F.count(F.lit(1)).alias("size"))
    order = Window.orderBy(F.desc("size"), "rep")  # a row a group
    numbered = final.join(sizes.select("rep", "size", (F.row_number().over(order) - 1).alias("group_idx")), "rep")
    # The representative first, then members by name: numbered over all tasks.
    first = (F.col("file") != F.col("rep")).cast("int")
    numbered = running_total(numbered.withColumn("after", first), ["group_idx"], ["after", "file"], F.lit(1).cast("long"), "member_idx")
    written = stored(numbered.select(die, "group_idx", F.col("member_idx").cast("int"), "file", "rep", "size"))
    sinks.write_groups(written.select("die_id", "group_idx", "member_idx", "file"), args.out, args.summary_data)
    sinks.tiles(written, args.summary_max_members).write.mode("overwrite").parquet(f"{args.out}/tiles")
    for r in sizes.orderBy(F.desc("size"), "rep").toLocalIterator():
        print(f"{r['size']} files, first {r.rep}")


def index(spark, args) -> None:
    """Builds the report page of a chart index over histogram files."""
    shown = files.read_chart_index(spark, args.index).withColumn("data_ids", F.transform("filenames", lambda f: F.regexp_replace(f, r"\.csv$", "")))
    data = files.read_histograms(spark, args.histograms).withColumnRenamed("name", "data_id")
    for r in charts.missing_data(shown, data).orderBy("chart_id", "data_id").collect():
        raise SystemExit(f"chart {r.chart_id}: no histogram {r.data_id}")
    for r in charts.name_mismatches(shown).collect():
        raise SystemExit(f"chart {r.chart_id}: names and series differ in number")
    page = sinks.report(shown, data, args.title)
    for text in sinks.unfilled(page):
        print(f"not filled in: {text}")
    with open(args.out, "w", encoding="utf-8") as f:  # a small page, on the machine that runs the command
        f.write(page)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rollstats", description=re.sub(r"\n\n.*", "", __doc__, flags=re.S))
    sub = p.add_subparsers(required=True)
    s = sub.add_parser("summarize", help=summarize.__doc__)
    s.add_argument("labels", help="pattern of label files, e.g. data/*/labels.csv")
    s.add_argument("--num-labels", "-n", type=int)
    s.add_argument("--resamples", type=int, default=1000)
    s.add_argument("--csv", help="folder for histograms")
    s.add_argument("--sequence-graph", help="folder for the grey cells of the transition matrices")
    s.set_defaults(run=summarize)
    c = sub.add_parser("combine", help=combine.__doc__)
    c.add_argument("histograms", nargs="+")
    c.set_defaults(run=combine)
    lb = sub.add_parser("label", help=label.__doc__)
    lb.add_argument("summary_data")
    lb.add_argument("labels", help="folder to write")
    lb.add_argument("values", nargs="+", type=int)
    lb.add_argument("--repeat", type=int)
    lb.set_defaults(run=label)
    cr = sub.add_parser("crop", help=crop.__doc__)
    cr.add_argument("folder")
    cr.add_argument("out", help="folder for boxes and squares")
    cr.add_argument("--reference", default="reference.jpg")
    cr.add_argument("--crop-size", type=int, default=660)
    cr.add_argument("--resize", type=int, default=6, help="photos are made smaller by this factor for the search")
    cr.add_argument("--threshold", type=int, default=180, help="summed channel difference of a pixel that counts")
    cr.add_argument("--number", "-n", type=int, help="photos to look at")
    cr.add_argument("--force", "-f", action="store_true", help="photos that have a result, too")
    cr.set_defaults(run=crop)
    g = sub.add_parser("group", help=group.__doc__)
    g.add_argument("folder")
    g.add_argument("out")
    g.add_argument("--matches", help="Parquet table of candidates: item, leader, inliers, scale, features_a, features_b")
    g.add_argument("--match-count-threshold", "-m", type=int, default=32)
    g.add_argument("--scale-threshold", type=float, default=float("inf"))
    g.add_argument("--feature-threshold", type=float, default=1.2)
    g.add_argument("--summary-data", "-d", default="summary.json", help="name of the file of groups")
    g.add_argument("--summary-max-members", type=int, default=35)
    g.set_defaults(run=group)
    ix = sub.add_parser("index", help=index.__doc__)
    ix.add_argument("index", help="chart index, JSON by chart")
    ix.add_argument("histograms", help="pattern of histogram files")
    ix.add_argument("out", help="page to write")
    ix.add_argument("--title", default="Dice")
    ix.set_defaults(run=index)
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(session(), args)


if __name__ == "__main__":
    main()
