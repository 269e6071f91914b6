"""Queries over files and photos: what the writers write is read back, photos are drawn from table rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import shared_dir
from ..operators import charts, grouping, imaging, labeling
from ..sources import files, sinks
from ..streaming import live
from .dice import _CI, _histogram, rounded
from .views import EVENT_SIDES, _read, grouped_files, rolls_by_user, with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


@contextmanager
def split_size(spark, size: int) -> Iterator[None]:
    """Files are read in splits of ``size`` bytes meanwhile, so that small files have several, too."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- labels, histograms, groups ------------------------------------------------------


@query("SELECT die_id, row_number() OVER (PARTITION BY die_id ORDER BY seq) AS seq, CAST(side AS INTEGER) AS side FROM rolls_by_user", "rolls_by_user")
def labels_round_trip(spark, sf_dir):
    """Label files, a comment line first, written a die each and read back in their order."""
    at = _place(spark, "labels")
    sequence = rolls_by_user(spark, sf_dir).select("die_id", "seq", F.col("side").alias("label"))
    sinks.write_labels(sequence, at, "labels from a query")
    return files.read_labels(spark, f"{at}/*/labels.csv").withColumn("die_id", F.regexp_replace("die_id", "^die_id=", ""))


@query("SELECT 'all' AS die_id, row_number() OVER (ORDER BY seq) AS seq, CAST(side AS INTEGER) AS side FROM rolls_by_user", "rolls_by_user")
def labels_one_die(spark, sf_dir):
    """All events as one die: one file, written from sorted ranges and read in splits."""
    at = _place(spark, "labels")
    sequence = rolls_by_user(spark, sf_dir).select(F.lit("all").alias("die_id"), "seq", F.col("side").alias("label"))
    sinks.write_labels(sequence, at, "labels from a query")
    with split_size(spark, 4096):
        return files.read_labels(spark, f"{at}/*/labels.csv").withColumn("die_id", F.regexp_replace("die_id", "^die_id=", ""))


_WRITTEN = "round(p, 5) AS p, round(ci_low, 5) AS ci_low, round(ci_high, 5) AS ci_high"


@query(_CI + f"SELECT die_id AS name, side, {_WRITTEN} FROM hist", "rolls_by_flag")
def histogram_round_trip(spark, sf_dir):
    """Histogram files, five decimals, read by position."""
    at = _place(spark, "histograms")
    sinks.write_histograms(rounded(_histogram(spark, sf_dir), "p", "ci_low", "ci_high"), at)
    return files.read_histograms(spark, f"{at}/*/*.csv")


@query(_CI + f"SELECT side, {_WRITTEN} FROM hist WHERE die_id = 'N'", "rolls_by_flag")
def histogram_by_name(spark, sf_dir):
    """One die's file, its columns found by name."""
    at = _place(spark, "histograms")
    sinks.write_histograms(rounded(_histogram(spark, sf_dir).where("die_id = 'N'"), "p", "ci_low", "ci_high"), at)
    return files.read_histogram_by_name(spark, f"{at}/die_id=N")


@query("SELECT 'd' || CAST(group_idx % 2 AS VARCHAR) AS die_id, group_idx // 2 AS group_idx, CAST(row_number() OVER (PARTITION BY group_idx ORDER BY file) - 1 AS INTEGER) AS member_idx, file FROM grouped_files", "grouped_files")
def groups_round_trip(spark, sf_dir):
    """Groupings as JSON lists of lists, a die each, read back."""
    f = grouped_files(spark, sf_dir)
    member = F.row_number().over(Window.partitionBy("group_idx").orderBy("file")) - 1
    groups = f.select(F.concat(F.lit("d"), (F.col("group_idx") % 2).cast("string")).alias("die_id"), F.floor(F.col("group_idx") / 2).cast("int").alias("group_idx"), member.alias("member_idx"), "file")
    at = _place(spark, "groups")
    sinks.write_groups(groups, at)
    return files.read_group_lines(spark, f"{at}/*/summary.json").withColumn("die_id", F.regexp_replace("die_id", "^die_id=", ""))


#: A chart a customer: order priorities are its series, order states its names; every third has none, every second a fair value.
_CHART_ROWS = """WITH o AS (SELECT o_custkey AS k, list_sort(list(DISTINCT o_orderpriority)) AS filenames, list_sort(list(DISTINCT o_orderstatus)) AS names FROM orders GROUP BY 1),
i AS (SELECT CAST(k AS VARCHAR) AS chart_id, c_name AS title, CASE WHEN k % 3 <> 0 THEN names END AS names, filenames, CASE WHEN k % 2 = 0 THEN 1 / len(filenames) END AS fair
  FROM o JOIN customer ON k = c_custkey) """


def _chart_rows(spark, sf_dir) -> DataFrame:
    """Charts made of customers and orders, as index files that are written and read: an object by chart each."""
    orders = _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(
        F.sort_array(F.collect_set("o_orderpriority")).alias("filenames"), F.sort_array(F.collect_set("o_orderstatus")).alias("names")
    )
    customers = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("title"))
    entry = F.struct(
        "title", F.when(F.col("k") % 3 != 0, F.col("names")).alias("names"), "filenames", F.when(F.col("k") % 2 == 0, 1 / F.size("filenames")).alias("fairValue")
    )
    charts = orders.join(customers, "k").select("k", F.concat(F.lit('"'), F.col("k").cast("string"), F.lit('": '), F.to_json(entry)).alias("entry"))
    # An index file holds a thousand customers.
    text = charts.groupBy(F.floor(F.col("k") / 1000).alias("file")).agg(F.concat(F.lit("{"), F.array_join(F.collect_list("entry"), ", "), F.lit("}")).alias("value"))
    at = _place(spark, "index")
    text.write.partitionBy("file").text(at)
    return files.read_chart_index(spark, f"{at}/*/*.txt")


@query(_CHART_ROWS + "SELECT chart_id, title, array_to_string(names, ',') AS names, array_to_string(filenames, ',') AS filenames, round(fair, 9) AS fair FROM i")
def chart_index(spark, sf_dir):
    """Index files, a JSON object by chart each, read back."""
    index = _chart_rows(spark, sf_dir)
    return index.select("chart_id", "title", F.array_join("names", ",").alias("names"), F.array_join("filenames", ",").alias("filenames"), F.round("fairValue", 9).alias("fair"))


@query(_CHART_ROWS + "SELECT chart_id FROM i WHERE names IS NOT NULL AND len(names) <> len(filenames)")
def chart_name_check(spark, sf_dir):
    """Charts with another number of names than of series."""
    return charts.name_mismatches(_chart_rows(spark, sf_dir).withColumnRenamed("filenames", "data_ids"))


@query(
    _CHART_ROWS + """, g AS (SELECT chart_id, len(filenames) AS k, CASE WHEN len(filenames) > 4 THEN 6 ELSE 12 END AS w, CASE WHEN len(filenames) > 1 THEN 1 ELSE 3 END AS m FROM i)
    SELECT chart_id, w AS bar_width, m AS bar_margin, CAST(CASE WHEN k > 1 THEN (k + 2) * (w + m) ELSE w + m END AS INTEGER) AS group_width FROM g"""
)
def bar_geometry(spark, sf_dir):
    """Widths and margins of each chart's bars."""
    return _chart_rows(spark, sf_dir).select("chart_id", charts.geometry(F.size("filenames")).alias("g")).select("chart_id", "g.*")


@query(
    """SELECT CAST(p_partkey // 20 AS VARCHAR) AS die_id, CAST(p_partkey % 20 + 1 AS INTEGER) AS side, CAST(20 - p_partkey % 20 AS INTEGER) AS opp, CAST(p_size AS DOUBLE) AS mm, p_size - 25.5::DOUBLE AS dd,
    p_retailprice AS pside, p_size / 50 AS popp FROM part"""
)
def diameters(spark, sf_dir):
    """Sheets of measured diameters, twenty parts a die: rows of tab-separated numbers, then notes."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    cells = {"side": (k % 20 + 1).cast("int"), "opp": (20 - k % 20).cast("int"), "mm": size, "dd": size - 25.5, "pside": F.col("p_retailprice"), "popp": size / 50}
    sides = _read(spark, sf_dir, "part").select(F.floor(k / 20).cast("string").alias("die_id"), *(c.alias(n) for n, c in cells.items()))
    rows = sides.groupBy("die_id").agg(F.sort_array(F.collect_list(F.struct(*cells))).alias("all"))
    line = lambda n: F.concat_ws("\t", F.lit(n), F.transform("all", lambda x: x[n].cast("string")))
    return files.parse_diameters(rows.select("die_id", F.concat_ws("\n", *(line(n) for n in files.DIAMETERS), F.lit(""), F.lit("measured by hand")).alias("value")))


@query(_CI + "SELECT die_id AS data_id, side, round(p, 9) AS p, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high FROM hist", "rolls_by_flag")
def report_data(spark, sf_dir):
    """The report page's embedded series, read back from the page."""
    data = _histogram(spark, sf_dir).withColumnRenamed("die_id", "data_id")
    shown = spark.createDataFrame([("c", "Cost $1 </script>", ["A", "N", "R"])], "chart_id string, title string, data_ids array<string>")
    page = sinks.report(shown, data, "Dice & more")
    rows = [(k, r["side"], float(r["p"]), float(r["ci_low"]), float(r["ci_high"])) for k, v in sinks.report_data(page).items() for r in v]
    return rounded(spark.createDataFrame(rows, f"data_id string, {files.HISTOGRAM}"), "p", "ci_low", "ci_high")


# --- folders ---------------------------------------------------------------------------


@query("SELECT file || '.JPG' AS file FROM grouped_files WHERE group_idx % 3 = 0 AND file <> '000000000000'", "grouped_files")
def image_scan(spark, sf_dir):
    """Photos among other files, but for the reference photo; extensions in any case."""
    end = F.when(F.col("group_idx") % 3 == 0, ".JPG").when(F.col("group_idx") % 3 == 1, ".txt").otherwise(".jpg.bak")
    return files.image_names(grouped_files(spark, sf_dir).select(F.concat("file", end).alias("file")), "000000000000.jpg")


@query(
    ", f AS (SELECT DISTINCT CAST(group_idx AS VARCHAR) AS die_id, group_idx FROM grouped_files) SELECT die_id, CASE WHEN group_idx % 4 = 1 THEN 'no labels' ELSE 'labels found' END AS message FROM f",
    "grouped_files",
)
def dataset_catalogue(spark, sf_dir):
    f = grouped_files(spark, sf_dir).select(F.col("group_idx").cast("string").alias("die_id"), "group_idx")
    return files.catalogue(f.select("die_id").distinct(), f.where("group_idx % 4 != 1"))


@query("SELECT file, 'no region' AS not_found FROM grouped_files WHERE group_idx = 5", "grouped_files")
def not_found_list(spark, sf_dir):
    f = grouped_files(spark, sf_dir)
    return labeling.not_found_files(f.select("file", (F.col("group_idx") < 3).alias("skipped"), F.when(F.col("group_idx").isin(2, 5), "no region").alias("not_found")))


@query(f"SELECT user_id::VARCHAR AS die_id, CAST(list_position({list(EVENT_SIDES)}, event_type) AS INTEGER) AS side, count(*) AS n FROM events GROUP BY ALL")
def stream_snapshot(spark, sf_dir):
    """The last snapshot of a run: the events as a stream, counted so far."""
    events = live.event_stream(spark, _read(spark, sf_dir, "events").schema, f"{sf_dir}/events.parquet*")
    side = F.array_position(F.array(*(F.lit(x) for x in EVENT_SIDES)), F.col("event_type")).cast("int")
    rolls = events.select(F.col("user_id").cast("string").alias("die_id"), side.alias("side"))
    at = _place(spark, "snapshots")
    live.snapshots(rolls, at, _place(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    seen = spark.read.schema("die_id string, side int, n long, batch long").parquet(at)
    return seen.join(seen.agg(F.max("batch").alias("batch")), "batch").select("die_id", "side", "n")


@query(
    """WITH a AS (SELECT user_id AS rig, event_id AS "at", event_id // 4000 AS run, event_type <> 'error' AS ok FROM events),
    f AS (SELECT *, count(*) FILTER (NOT ok) OVER (PARTITION BY rig, run ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS failed FROM a),
    n AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY rig ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS number FROM f WHERE failed < 3)
    SELECT rig, "at", CASE WHEN ok THEN number END AS number, CASE WHEN ok THEN lpad(CAST(number AS VARCHAR), 5, '0') || '.JPG' END AS file FROM n WHERE number < 40"""
)
def acquisition_run(spark, sf_dir):
    """Events as attempts of rigs: numbered photos, until a run has three failures or a rig has forty photos."""
    events = live.event_stream(spark, _read(spark, sf_dir, "events").schema, f"{sf_dir}/events.parquet*")
    attempts = events.select(F.col("user_id").alias("rig"), F.col("event_id").alias("at"), F.floor(F.col("event_id") / 4000).cast("long").alias("run"), (F.col("event_type") != "error").alias("ok"))
    at = _place(spark, "acquired")
    taken = live.acquire(attempts, rolls=40, errors=3)
    taken.writeStream.format("parquet").option("checkpointLocation", _place(spark, "stream")).trigger(availableNow=True).start(at).awaitTermination()
    return spark.read.schema(taken.schema).parquet(at)


# --- maps between photos -------------------------------------------------------------------

_MAP = "[1 + p_size / 50.0, 0.1, 3.0, 0.05, 1 - p_size / 200.0, 2.0, p_size / 10000.0, 0.0, 1.0]::DOUBLE[]"


@query(
    f"""WITH m AS (SELECT p_partkey, {_MAP} AS h FROM part), q AS (SELECT p_partkey, h, h[3] / h[9] AS ox, h[6] / h[9] AS oy, (h[1] + h[3]) / (h[7] + h[9]) AS ax,
    (h[4] + h[6]) / (h[7] + h[9]) AS ay, (h[2] + h[3]) / (h[8] + h[9]) AS bx, (h[5] + h[6]) / (h[8] + h[9]) AS by_ FROM m),
    s AS (SELECT p_partkey, abs(1 - sqrt((ax - ox) ** 2 + (ay - oy) ** 2)) + abs(1 - sqrt((bx - ox) ** 2 + (by_ - oy) ** 2)) AS s FROM q)
    SELECT p_partkey, round(greatest(s, 1 / s), 8) AS scale FROM s"""
)
def scale_distortion(spark, sf_dir):
    size = F.col("p_size").cast("double")
    h = F.array(1 + size / 50, F.lit(0.1), F.lit(3.0), F.lit(0.05), 1 - size / 200, F.lit(2.0), size / 10000, F.lit(0.0), F.lit(1.0))
    return _read(spark, sf_dir, "part").select("p_partkey", F.round(grouping.scale_column(h), 8).alias("scale"))


@query(
    """WITH c AS (SELECT CAST(c_nationkey AS VARCHAR) AS pair, c_custkey FROM customer), n AS (SELECT pair, count(*) AS n, count(*) FILTER (c_custkey % 7 <> 0) AS inliers FROM c GROUP BY pair)
    SELECT pair, CASE WHEN inliers >= 12 THEN inliers ELSE 0 END AS inliers FROM n WHERE inliers >= 12"""
)
def match_inliers(spark, sf_dir):
    """Matches of one projective map, one in seven wrong: the consensus finds the others. Pairs of few points are left out."""
    k = F.col("c_custkey")
    # Places spread like hash values, so that no three are in line for long.
    x, y = F.pmod(F.xxhash64(k), F.lit(997)).cast("double"), F.pmod(F.xxhash64(k, F.lit(1)), F.lit(991)).cast("double")
    w = 1 + x / 5000
    wrong = F.when(k % 7 == 0, 300 + 40 * (k % 11)).otherwise(0).cast("double")
    m = _read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("pair"), k.alias("k"), x.alias("x"), y.alias("y"), ((2 * x + 3) / w + wrong).alias("x2"), ((2 * y + x / 10) / w - wrong).alias("y2"))
    enough = m.where("k % 7 != 0").groupBy("pair").count().where("count >= 12").select("pair")
    return grouping.verify_matches(m.drop("k").join(enough, "pair", "left_semi")).select("pair", "inliers")


@query(
    """, g AS (SELECT CAST(group_idx % 3 AS VARCHAR) AS die_id, CAST(group_idx AS VARCHAR) AS rep, group_idx, count(*) // (1 + 3 * group_idx) AS size FROM grouped_files GROUP BY group_idx),
    r AS (SELECT *, row_number() OVER (PARTITION BY die_id ORDER BY size DESC, rep) AS rank, count(*) OVER (PARTITION BY die_id) AS k, max(size) OVER (PARTITION BY die_id) AS top FROM g),
    e AS (SELECT *, coalesce(min(CASE WHEN rank > 1 AND size < top / 4 THEN rank END) OVER (PARTITION BY die_id), k) AS edge FROM r),
    s AS (SELECT *, rank >= edge AND k > 1 AS small FROM e),
    m AS (SELECT a.die_id, a.rep, min_by(b.rep, b.rank) AS new_rep FROM s a JOIN s b ON a.die_id = b.die_id AND a.small AND NOT b.small AND b.group_idx < 3 AND (a.group_idx + b.group_idx) % 2 = 1 GROUP BY ALL)
    SELECT s.die_id, s.rep, coalesce(new_rep, s.rep) AS new_rep FROM s LEFT JOIN m ON m.die_id = s.die_id AND m.rep = s.rep""",
    "grouped_files",
)
def reparent_small(spark, sf_dir):
    """Small groups go to the first large group whose representative matches: here, one of the first three groups, of the other parity."""
    f = grouped_files(spark, sf_dir)
    sizes = f.groupBy("group_idx").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("group_idx", F.floor(F.col("n") / (1 + 3 * F.col("group_idx"))).cast("int").alias("size"))
    die, rep = (F.col("group_idx") % 3).cast("string").alias("die_id"), F.col("group_idx").cast("string").alias("rep")
    members = sizes.select(die, rep, F.explode_outer(F.sequence(F.lit(1), F.col("size"))).alias("k"), "size")
    groups = members.select("die_id", "rep", F.when(F.col("size") > 0, F.concat("rep", F.lit("-"), F.col("k").cast("string"))).alias("member"), "size", F.col("k").alias("match_count"))
    reps = sizes.select(die, rep, "group_idx")
    other = reps.select("die_id", F.col("rep").alias("other"), F.col("group_idx").alias("o"))
    relation = reps.join(other, "die_id").where((F.col("o") < 3) & ((F.col("group_idx") + F.col("o")) % 2 == 1)).select("die_id", F.col("rep").alias("item"), "other")
    return grouping.reparent(groups, relation)


# --- photos --------------------------------------------------------------------------------

WIDTH, HEIGHT, FACTOR = 240, 180, 3


def _photos(spark, sf_dir) -> DataFrame:
    """A photo a nation: a bright square on black, its place and size from the key; of every five one without and one far too large."""

    def draw(batches):
        for b in batches:
            data = []
            for k in b["n_nationkey"]:
                photo = np.zeros((HEIGHT, WIDTH, 3), dtype=np.uint8)
                x, y, size = _square(k)
                photo[y : y + size, x : x + size] = 200
                data.append(photo.tobytes())
            yield pd.DataFrame({"file": [f"{k:03}.jpg" for k in b["n_nationkey"]], "width": WIDTH, "height": HEIGHT, "channels": 3, "data": data})

    def _square(k: int) -> tuple[int, int, int]:
        return 3 * (5 + k % 13), 3 * (4 + k % 7), {0: 0, 1: 90}.get(k % 5, 60)

    return _read(spark, sf_dir, "nation").select("n_nationkey").mapInPandas(draw, "file string, width int, height int, channels int, data binary")


def _detected(spark, sf_dir) -> DataFrame:
    return imaging.detect(_photos(spark, sf_dir), (WIDTH, HEIGHT, 3, bytes(WIDTH * HEIGHT * 3)), distance=10, factor=FACTOR)


_FOUND = """WITH n AS (SELECT n_nationkey AS k, lpad(CAST(n_nationkey AS VARCHAR), 3, '0') || '.jpg' AS file, 3 * (5 + n_nationkey % 13) AS x, 3 * (4 + n_nationkey % 7) AS y FROM nation),
f AS (SELECT file, CASE k % 5 WHEN 0 THEN 'no region' WHEN 1 THEN 'region of 900 pixels' END AS not_found, CASE WHEN k % 5 > 1 THEN x END AS x_min, CASE WHEN k % 5 > 1 THEN y END AS y_min,
  CASE WHEN k % 5 > 1 THEN x + 57 END AS x_max, CASE WHEN k % 5 > 1 THEN y + 57 END AS y_max, CASE WHEN k % 5 > 1 THEN 400::BIGINT END AS npx FROM n) """


_BOX = ("x_min", "y_min", "x_max", "y_max", "npx")


@query(_FOUND + f"SELECT file, not_found, {', '.join(f'{c}::DOUBLE AS {c}' for c in _BOX)} FROM f")
def detect_die(spark, sf_dir):
    """Difference with the reference photo, scan, flood fill, and the reasons where nothing is found; numbers null there, and so doubles."""
    return _detected(spark, sf_dir).select("file", "not_found", *(F.col(c).cast("double").alias(c) for c in _BOX))


@query(_FOUND + ", c AS (SELECT file, greatest(0, greatest(0, x_min - 22)) AS x, greatest(0, y_min - 22) AS y, x_min, y_min FROM f WHERE not_found IS NULL) SELECT file, x AS low_x, x + 100 AS high_x, y AS low_y, y + 100 AS high_y FROM c")
def crop_squares(spark, sf_dir):
    """Squares of 100 pixels around the boxes, inside the photo."""
    found = imaging.crop_bounds(_detected(spark, sf_dir).where("not_found is null"), WIDTH, HEIGHT, 100)
    return found.select("file", F.col("crop_x.low").alias("low_x"), F.col("crop_x.high").alias("high_x"), F.col("crop_y.low").alias("low_y"), F.col("crop_y.high").alias("high_y"))


@query(_FOUND + "SELECT file, (x_min + x_max) / 2 AS x, (y_min + y_max) / 2 AS y, 28.5::DOUBLE AS radius_x, 28.5::DOUBLE AS radius_y FROM f WHERE not_found IS NULL")
def bounds_overlay(spark, sf_dir):
    """The ellipses of the overview of all boxes."""
    return imaging.overlay(_detected(spark, sf_dir))


@query("SELECT lpad(CAST(n_nationkey AS VARCHAR), 3, '0') || '.png' AS file, CAST(n_nationkey % 6 + 1 AS INTEGER) AS num_pips FROM nation")
def pip_count(spark, sf_dir):
    """Dark squares of a pip's size on bright faces, with specks too small to count."""

    def draw(batches):
        for b in batches:
            data = []
            for k in b["n_nationkey"]:
                face = np.full((120, 160), 230, dtype=np.uint8)
                for n in range(k % 6 + 1):
                    face[10 + 55 * (n // 3) : 40 + 55 * (n // 3), 10 + 50 * (n % 3) : 40 + 50 * (n % 3)] = 20
                face[115:118, ::20] = 20
                data.append(face.tobytes())
            yield pd.DataFrame({"file": [f"{k:03}.png" for k in b["n_nationkey"]], "width": 160, "height": 120, "grey": data})

    images = _read(spark, sf_dir, "nation").select("n_nationkey").mapInPandas(draw, "file string, width int, height int, grey binary")
    return grouping.count_pips(images)
