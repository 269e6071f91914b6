"""Writers: labels, histograms, groupings, reports. Distributed files, or one small file on request."""

from __future__ import annotations

import html
import json
import os
import re
import string
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def histogram_text(histogram: DataFrame) -> DataFrame:
    """Numbers with five decimals, as they are written."""
    return histogram.select(
        *[c for c in histogram.columns if c not in ("p", "ci_low", "ci_high")],
        *(F.format_string("%.5f", F.col(c).cast("double")).alias(c) for c in ("p", "ci_low", "ci_high")),
    )


def write_histograms(histogram: DataFrame, path: str) -> None:
    """CSV with a header, one folder a die."""
    text = histogram_text(histogram).repartition("die_id").sortWithinPartitions("die_id", "side")
    text.write.partitionBy("die_id").csv(path, header=True)


def write_labels(sequence: DataFrame, path: str, comment: str, label_file: str | None = "labels.csv") -> None:
    """A comment line, then the labels of ``sequence(die_id, seq, label)`` in order, a die a folder.

    Rows are sorted range by range over all tasks and written as parts whose names
    sort like the ranges, so no row and no task holds a long die.  With ``label_file`` a die is one file
    of that name, without a line feed at its end: written by the task that holds it whole (see :func:`write_whole_dice`),
    or joined from parts (see :func:`join_parts`); without it parts stay, and readers take a folder's parts in order.
    """
    first = sequence.groupBy("die_id").agg(F.min("seq").alias("seq")).select("die_id", "seq", F.lit(0).alias("_kind"), F.lit(f"# {comment}").alias("value"))
    lines = sequence.select("die_id", "seq", F.lit(1).alias("_kind"), F.col("label").cast("string").alias("value"))
    _write_lines(first.union(lines), ["seq", "_kind"], path, label_file)


#: Bytes of a die's lines, about, that a task holds and writes as one file; longer ones are written in parts.
HELD_BYTES, LINE_BYTES = 1 << 23, 32


def _write_lines(lines: DataFrame, order: list[str], path: str, name: str | None) -> None:
    """``lines(die_id, ..., value)`` in order, a die a folder of parts, or a file."""
    dealt = lines.repartitionByRange("die_id", *order).sortWithinPartitions("die_id", *order)
    root = lines.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(lines.sparkSession._jsc.hadoopConfiguration()).makeQualified(root).toUri()
    if name and root.getScheme() == "file":
        dealt = write_whole_dice(dealt, root.getPath(), name).sortWithinPartitions("die_id", *order)
    dealt.select("die_id", "value").write.partitionBy("die_id").text(path)
    if name:
        join_parts(lines.sparkSession, path, name)


def die_folder(die: str | None) -> str:
    """The name of a die's folder, as Spark's writer escapes it."""
    escaped = re.sub(r"[\x01-\x1f\"#%'*/:=?\\\x7f{\[\]^]", lambda m: f"%{ord(m[0]):02X}", die or "")
    return f"die_id={escaped or '__HIVE_DEFAULT_PARTITION__'}"


def write_whole_dice(dealt: DataFrame, folder: str, name: str) -> DataFrame:
    """Tasks write the dice that they hold whole, a file ``name`` each below the shared ``folder``; the lines of all others are returned.

    Rows are sorted range by range, so a die that neither begins nor ends a task's rows is nowhere else.  What is
    returned are two dice a range at most, and those of over ``HELD_BYTES``: their number does not grow with the dice.
    A file gets its name when it is whole, so a task can be repeated.
    """
    schema, limit = dealt.schema, HELD_BYTES

    def write(die: str | None, text: list[str]) -> None:
        at = os.path.join(folder, die_folder(die))
        os.makedirs(at, exist_ok=True)
        open_ = os.path.join(at, f"_{name}-{uuid.uuid4().hex}")
        with open(open_, "w", encoding="utf-8", newline="") as out:
            out.write("\n".join(text))
        os.replace(open_, os.path.join(at, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        text: list[str] = []
        size, last, passed_on = 0, None, True
        for k, batch in enumerate(b for b in batches if b.num_rows):
            # Null and empty names share a folder.
            dice = [d or None for d in batch.column("_die").to_pylist()]
            values, rows, at = batch.column("value").to_pylist(), batch.drop_columns(["_die"]), 0
            if k == 0:
                last = dice[0]
            for die, group in groupby(dice):
                n = sum(1 for _ in group)
                if die != last:
                    if not passed_on:
                        write(last, text)
                    held, text, size, last, passed_on = [], [], 0, die, False
                part = rows.slice(at, n)
                if passed_on:
                    yield part
                else:
                    held.append(part)
                    text += (v or "" for v in values[at : at + n])
                    size += sum(len(v) + LINE_BYTES for v in text[-n:])
                    if size > limit:
                        yield from held
                        held, text, passed_on = [], [], True
                at += n
        yield from held

    return dealt.withColumn("_die", F.col("die_id").cast("string")).mapInArrow(run, schema)


#: Folders that are joined at a time.
JOINED_AT_ONCE = 16


def join_parts(spark: SparkSession, path: str, name: str) -> None:
    """In every folder below ``path`` that has parts they become one file ``name``, without the last line feed.

    One file is the format, and one stream writes it: parts are copied by the file system's
    own interface in buffers of a megabyte, wherever the files are, in the order of their names.  The file gets its name when it is
    whole, and parts go after that: a join that is broken off can be repeated.  Folders are joined ``JOINED_AT_ONCE`` at a time.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)

    def join(parts: list) -> None:
        folder = parts[0].getPath().getParent()
        parts = [f for f in parts if f.getLen()]
        whole = jvm.org.apache.hadoop.fs.Path(folder, name)
        open_ = jvm.org.apache.hadoop.fs.Path(folder, f"_{name}")
        out = fs.create(open_, True)
        for k, part in enumerate(parts):
            source = fs.open(part.getPath())
            # All bytes, but for the line feed at the end of the last part.
            body = jvm.org.apache.hadoop.util.LimitInputStream(source, part.getLen() - (k == len(parts) - 1))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(body, out, 1 << 20, False)
            source.close()
        out.close()
        fs.delete(whole, False)
        fs.rename(open_, whole)
        for part in parts:
            fs.delete(part.getPath(), False)

    # All folders in one call; what comes back are parts only.
    folders = jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(fs.listStatus(root))
    parts = sorted((str(f.getPath()), f) for f in fs.listStatus(folders, jvm.org.apache.hadoop.fs.GlobFilter("part-*")))
    with ThreadPoolExecutor(JOINED_AT_ONCE) as pool:
        list(pool.map(join, ([f for _, f in group] for _, group in groupby(parts, lambda p: p[0].rpartition("/")[0]))))


def write_groups(groups: DataFrame, path: str, group_file: str | None = "summary.json") -> None:
    """A die's grouping as a JSON list of lists of files, a member a line: no row holds a group.

    ``groups(die_id, group_idx, member_idx, file)``: members in order, the
    representative first; indices of groups and members count from 0 without gaps.
    """
    ends = groups.groupBy("die_id").agg(F.max(F.struct("group_idx", "member_idx")).alias("last"))
    sizes = groups.groupBy("die_id", "group_idx").agg(F.max("member_idx").alias("of_last"))
    row = groups.join(ends, "die_id").join(sizes, ["die_id", "group_idx"])
    name = F.substring(F.to_json(F.array("file")), 2, 1 << 30)  # "file"]
    name = F.substring(name, F.lit(1), F.length(name) - 1)
    begin = F.when((F.col("group_idx") == 0) & (F.col("member_idx") == 0), "[[").when(F.col("member_idx") == 0, "[").otherwise("")
    whole = (F.col("group_idx") == F.col("last.group_idx")) & (F.col("member_idx") == F.col("last.member_idx"))
    end = F.when(whole, "]]").when(F.col("member_idx") == F.col("of_last"), "],").otherwise(",")
    lines = row.select("die_id", "group_idx", "member_idx", F.concat(begin, name, end).alias("value"))
    _write_lines(lines, ["group_idx", "member_idx"], path, group_file)


def groups_json(groups: DataFrame) -> DataFrame:
    """``(die_id, value)``: lists of lists of files, members in order, the representative first."""
    members = groups.groupBy("die_id", "group_idx").agg(F.array_sort(F.collect_list(F.struct("member_idx", "file"))).alias("m"))
    lists = members.groupBy("die_id").agg(F.array_sort(F.collect_list(F.struct("group_idx", F.col("m.file").alias("files")))).alias("g"))
    return lists.select("die_id", F.to_json(F.col("g.files")).alias("value"))


def tiles(members: DataFrame, cap: int = 35, size: int = 90, limit: int = 65_500) -> DataFrame:
    """Places of the overview image: one row a group, at most ``cap`` tiles and ``limit`` pixels a row."""
    return members.where(F.col("member_idx") < min(cap, limit // size)).select(
        "group_idx", "file", (F.col("member_idx") * size).alias("x"), (F.col("group_idx") * size).alias("y")
    )


_PAGE = string.Template(
    "<!DOCTYPE html><html><head><meta charset='utf-8'><title>$title</title></head><body><h1>$title</h1>"
    "<script>const data = $data; const charts = $charts;</script></body></html>"
)


def report(charts: DataFrame, histograms: DataFrame, title: str) -> str:
    """An HTML page with the chart configuration and the series it needs; both are small by construction."""
    rows = histograms.groupBy("data_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("side", "p", "ci_low", "ci_high")))).alias("j"))
    data = {r.data_id: json.loads(r.j) for r in rows.collect()}
    config = {r.chart_id: {k: v for k, v in r.asDict().items() if k != "chart_id"} for r in charts.collect()}
    return _PAGE.substitute(title=html.escape(title), data=_script(data), charts=_script(config))


def _script(value) -> str:
    """JSON that can stand in a script element."""
    return json.dumps(value).replace("</", "<\\/")


def unfilled(page: str) -> list[str]:
    """Texts with a ``$`` outside of scripts, which a template should have filled in."""
    return re.findall(r"[^\n<>]*\$[^\n<>]*", re.sub(r"(?s)<script\b.*?</script>", "", page))


def report_data(page: str) -> dict:
    """The histograms of a :func:`report` page, by data id."""
    return json.loads(re.search(r"const data = (.*?); const charts = ", page, re.S)[1])
