"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its measured size is at most this many bytes.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A folder of our own is set only where the session names none and driver and
    executors are one process (tests on one machine); on a cluster that is an error,
    as each executor would write to a disk of its own.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Bytes and rows of a batch that a Python worker gets at once, in jobs that :func:`saved` starts.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings with ``values`` put in, and put back at the end."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage, survives lost executors, and computes ``df`` once however
    often the result is used.  Python workers get small batches meanwhile, so
    their memory does not depend on how long texts are on average.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with settings(spark, BATCH):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes :func:`saved` tables that no later job reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a table that :func:`saved` returned."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bounded(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A :func:`saved` table with a broadcast hint if its measured size allows it.

    Parquet packs small values tightly, so rows are measured as well as bytes.
    Beyond the limit the plain table comes back and Spark shuffles the join.
    """
    if stored_bytes(df) <= limit and df.count() * (16 + 16 * len(df.columns)) <= 4 * limit:
        return F.broadcast(df)
    return df


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(df: DataFrame, names: list[str] | None = None) -> list[Column]:
    """All columns, or those named, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in (df.columns if names is None else names)]


def any_of(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, terms)


def total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def span_string(spans: Column) -> Column:
    """``kind:start:end`` of an array of such structs, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")),
        ),
        ",",
    )
