"""The library's inputs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import sign_code

EVENT_SIDES = ("click", "error", "purchase", "signup", "view")


def _read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rolls_by_supplier(spark, sf_dir: str) -> DataFrame:
    """A d7 a supplier, without an order."""
    return _read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("die_id"), F.col("l_linenumber").alias("side"))


def rolls_by_flag(spark, sf_dir: str) -> DataFrame:
    """A d50 a return flag, without an order."""
    return _read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("die_id"), F.col("l_quantity").cast("int").alias("side"))


def rolls_by_user(spark, sf_dir: str) -> DataFrame:
    """A d5 a user, in the order of events."""
    side = F.array_position(F.array(*(F.lit(x) for x in EVENT_SIDES)), F.col("event_type")).cast("int")
    return _read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("die_id"), F.col("event_id").alias("seq"), side.alias("side"))


def descriptors(spark, sf_dir: str) -> DataFrame:
    """Binary descriptors: the signs of each embedding, in two halves."""
    return _read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("desc_id"), F.col("label").alias("image"), sign_code(F.col("embedding"), 1).alias("lo"), sign_code(F.col("embedding"), 33).alias("hi")
    )


def regions(spark, sf_dir: str) -> DataFrame:
    """Boxes with a pixel count, made from line items."""
    return _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        (F.col("l_orderkey") % 97).cast("int").alias("x_min"), (F.col("l_partkey") % 89).cast("int").alias("y_min"),
        F.col("l_quantity").cast("int").alias("dx"), (F.col("l_suppkey") % 40).cast("int").alias("dy"),
        (F.col("l_quantity") * F.col("l_linenumber") * 3).cast("int").alias("npx"),
    )


def grouped_files(spark, sf_dir: str) -> DataFrame:
    """``(group_idx, file)``: events as files, 12 groups; file names sort like the numbers."""
    return _read(spark, sf_dir, "events").select((F.col("user_id") % 12).cast("int").alias("group_idx"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("file"))


SQL = {
    "rolls_by_supplier": "SELECT CAST(l_suppkey AS VARCHAR) AS die_id, l_linenumber AS side FROM lineitem",
    "rolls_by_flag": "SELECT l_returnflag AS die_id, CAST(trunc(l_quantity) AS INTEGER) AS side FROM lineitem",
    "rolls_by_user": "SELECT CAST(user_id AS VARCHAR) AS die_id, event_id AS seq, list_position(['click','error','purchase','signup','view'], event_type) AS side FROM events",
    "descriptors": """SELECT vec_id AS desc_id, label AS image,
        CAST(list_sum([CASE WHEN embedding[i] > 0 THEN CAST(1 AS BIGINT) << (i - 1) ELSE 0 END FOR i IN range(1, 33)]) AS BIGINT) AS lo,
        CAST(list_sum([CASE WHEN embedding[i + 32] > 0 THEN CAST(1 AS BIGINT) << (i - 1) ELSE 0 END FOR i IN range(1, 33)]) AS BIGINT) AS hi FROM embeddings""",
    "regions": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_orderkey % 97 AS INTEGER) AS x_min, CAST(l_partkey % 89 AS INTEGER) AS y_min,
        CAST(trunc(l_quantity) AS INTEGER) AS dx, CAST(l_suppkey % 40 AS INTEGER) AS dy, CAST(trunc(l_quantity * l_linenumber * 3) AS INTEGER) AS npx FROM lineitem""",
    "grouped_files": "SELECT CAST(user_id % 12 AS INTEGER) AS group_idx, lpad(CAST(event_id AS VARCHAR), 12, '0') AS file FROM events",
}


def with_views(body: str, *names: str) -> str:
    """SQL with the named inputs as common table expressions; ``body`` starts with SELECT, or a comma and further expressions."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " " + body
