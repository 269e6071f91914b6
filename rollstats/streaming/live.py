"""Statistics while rolls come in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.files import _die, parse_labels


def label_stream(spark: SparkSession, pattern: str) -> DataFrame:
    """Labels of files as they are dropped; a file is read once."""
    text = spark.readStream.schema("value string").option("wholetext", True).text(pattern)
    return parse_labels(text.select(_die(F.col("_metadata.file_path")).alias("die_id"), "value"))


def running_counts(rolls: DataFrame) -> DataFrame:
    """Counts so far by die and side; state is one number a side. Use output mode update or complete."""
    return rolls.groupBy("die_id", "side").agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(rolls: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by time window for rolls with a ``ts``; rows later than ``late`` are dropped and old state freed."""
    timed = rolls.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", every), "die_id", "side").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("start"), "die_id", "side", "n"
    )


def snapshots(rolls: DataFrame, path: str, checkpoint: str):
    """Writes the counts so far, batch by batch, each to a folder of its own: a look at a run that goes on."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return running_counts(rolls).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write)


def photo_stream(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, taken, content)`` of photos as they are dropped: the counterpart of a camera that goes on.

    A query over it resumes by its checkpoint: photos that it has seen are not read again.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    photos = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.{jpg,JPG,jpeg,JPEG}").load(folder)
    return photos.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), F.col("modificationTime").alias("taken"), "content")


def event_stream(spark: SparkSession, schema, path: str) -> DataFrame:
    """Rows of Parquet files as they are dropped."""
    return spark.readStream.schema(schema).parquet(path)


#: Photos of a run, and failed ones after which it ends.
ROLLS, ERRORS = 3000, 10


def acquire(attempts: DataFrame, rolls: int = ROLLS, errors: int = ERRORS) -> DataFrame:
    """``(rig, at, number, file)`` of ``attempts(rig, at, run, ok)``, a stream: what a rig does with its photos.

    A good photo gets the next number, which is its file's name; a failed one has neither.  After ``errors``
    failures a run takes no more, and after ``rolls`` numbers nor does the rig.  A new ``run`` starts without
    failures and goes on at the next number.  State is three numbers a rig, kept with the query's checkpoint, so a query
    that starts again goes on where it was.  Attempts of a rig come in the order of ``at`` from batch to batch; in a batch they are sorted.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, failed, run = state.get if state.exists else (0, 0, -1)
        out = []
        # A rig's rows of one batch: the source's limits bound them.
        for at, of, ok in pd.concat(batches).sort_values("at")[["at", "run", "ok"]].itertuples(index=False):
            if of != run:
                failed, run = 0, int(of)
            if number >= rolls or failed >= errors:
                continue
            out.append((key[0], at, number if ok else None, f"{number:05d}.JPG" if ok else None))
            number, failed = number + bool(ok), failed + (not ok)
        state.update((number, failed, run))
        frame = pd.DataFrame(out, columns=["rig", "at", "number", "file"])
        yield frame.astype({"number": "Int64"})

    kind = dict(attempts.dtypes)["rig"]
    return attempts.select("rig", "at", "run", "ok").groupBy("rig").applyInPandasWithState(
        step, f"rig {kind}, at long, number long, file string", "number long, failed long, run long", "append", GroupStateTimeout.NoTimeout
    )
