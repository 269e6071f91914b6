"""Queries over rolls: counts, statistics, resampling, transitions, sums, text, charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import charts, rolls, stats
from ..sources import files
from .views import _read, rolls_by_flag, rolls_by_supplier, rolls_by_user, with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}
DIGITS = 9
PREFIXES = [10, 25, 50]
SUBSAMPLES = [16, 32]


def query(sql: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), DIGITS) for c in columns})


_COUNTS = ", c AS (SELECT die_id, side, count(*) AS n FROM {0} GROUP BY ALL)"
_SUPPLIER, _FLAG, _USER = (_COUNTS.format(v) for v in ("rolls_by_supplier", "rolls_by_flag", "rolls_by_user"))
_HIST = ", h AS (SELECT die_id, side, n / sum(n) OVER (PARTITION BY die_id) AS p, sum(n) OVER (PARTITION BY die_id) AS total FROM c)"


@query("SELECT die_id, side, count(*) AS n FROM rolls_by_supplier GROUP BY ALL", "rolls_by_supplier")
def label_counts(spark, sf_dir):
    return rolls.label_counts(rolls_by_supplier(spark, sf_dir))


@query(_FLAG + " SELECT die_id, side, n, round(n / sum(n) OVER (PARTITION BY die_id), 9) AS p FROM c", "rolls_by_flag")
def relative_freq(spark, sf_dir):
    return rounded(rolls.relative(rolls.label_counts(rolls_by_flag(spark, sf_dir))), "p")


@query(_FLAG + " SELECT die_id, side, n, round(n / avg(n) OVER (PARTITION BY die_id), 9) AS freq FROM c", "rolls_by_flag")
def normalized_freq(spark, sf_dir):
    return rounded(rolls.normalized(rolls.label_counts(rolls_by_flag(spark, sf_dir))), "freq")


@query(
    _SUPPLIER + _HIST + """ SELECT die_id, CAST(any_value(total) AS BIGINT) AS n, count(*) AS k, round(stddev_pop(p), 9) AS stddev, round(min(p), 9) AS min_p,
    round(max(p), 9) AS max_p, round(1 / count(*), 9) AS fair, round(sum(side * p), 9) AS expected FROM h GROUP BY die_id""",
    "rolls_by_supplier",
)
def summary_stats(spark, sf_dir):
    return rounded(stats.summary_stats(rolls_by_supplier(spark, sf_dir)), "stddev", "min_p", "max_p", "fair", "expected")


@query(
    _SUPPLIER + ", f AS (SELECT die_id, n / avg(n) OVER (PARTITION BY die_id) AS freq FROM c) SELECT die_id, round(stddev_pop(freq), 9) AS stddev FROM f GROUP BY die_id",
    "rolls_by_supplier",
)
def normalized_stddev(spark, sf_dir):
    return rounded(stats.normalized_stddev(rolls_by_supplier(spark, sf_dir)), "stddev")


_CHI = _SUPPLIER + """, e AS (SELECT *, avg(n) OVER (PARTITION BY die_id) AS e FROM c),
x AS (SELECT die_id, sum((n - e) ** 2 / e) AS x, count(*) - 1 AS dof FROM e GROUP BY die_id) """


@query(_CHI + "SELECT die_id, round(x, 8) AS statistic, dof FROM x", "rolls_by_supplier")
def chi2_statistic(spark, sf_dir):
    out = stats.chi_square(rolls_by_supplier(spark, sf_dir)).drop("p")
    return out.withColumn("statistic", F.round("statistic", 8))


@query(
    _CHI + """SELECT die_id, CASE WHEN dof <= 0 OR x <= 0 THEN 1.0 ELSE round(greatest(0, 1 - list_sum(list_transform(range(0, 400),
    lambda k: exp((dof / 2 + k) * ln(x / 2) - x / 2 - lgamma(dof / 2 + k + 1))))), 8) END AS p FROM x""",
    "rolls_by_supplier",
)
def chi2_pvalue(spark, sf_dir):
    return stats.chi_square(rolls_by_supplier(spark, sf_dir)).select("die_id", F.round("p", 8).alias("p"))


@query(
    _SUPPLIER + """, e AS (SELECT *, avg(n) OVER (PARTITION BY die_id) AS e FROM c),
    x AS (SELECT die_id, sum(n) AS n, sum((n - e) ** 2 / e) AS x, count(*) - 1 AS dof, stddev_pop(n / e) AS s FROM e GROUP BY die_id),
    d AS (SELECT CAST(s_suppkey AS VARCHAR) AS die_id, n_regionkey AS region, s_nationkey AS maker FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT region, maker, CAST(grouping(region) + grouping(maker) AS INTEGER) AS level, count(*) AS dice, CAST(sum(n) AS BIGINT) AS n, round(sum(x), 6) AS statistic, CAST(sum(dof) AS BIGINT) AS dof,
    round(avg(s), 9) AS stddev FROM x JOIN d USING (die_id) GROUP BY ROLLUP (region, maker)""",
    "rolls_by_supplier",
)
def fairness_rollup(spark, sf_dir):
    """Suppliers as dice, their nations as makers, by region: fairness of a maker, a region and all."""
    nations = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("maker"), F.col("n_regionkey").alias("region"))
    dice = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("die_id"), F.col("s_nationkey").alias("maker")).join(nations, "maker")
    out = stats.rolled_up(rolls_by_supplier(spark, sf_dir), dice, ["region", "maker"]).drop("p")
    return out.withColumns({"statistic": F.round("statistic", 6), "stddev": F.round("stddev", 9)})


@query(
    """, c AS (SELECT die_id, side, count(*) AS n FROM rolls_by_supplier GROUP BY ALL), t AS (SELECT die_id, unnest(range(0, greatest(max(side), 9) + 1)) AS side FROM c GROUP BY die_id)
    SELECT die_id, CAST(t.side AS INTEGER) AS side, coalesce(n, 0) AS n FROM t LEFT JOIN c USING (die_id, side)""",
    "rolls_by_supplier",
)
def dense_bincount(spark, sf_dir):
    return rolls.dense_counts(rolls_by_supplier(spark, sf_dir), 9)


@query(
    """, r AS (SELECT *, row_number() OVER (PARTITION BY die_id ORDER BY seq) AS k FROM rolls_by_user), s AS (SELECT unnest([10, 25, 50]) AS size),
    c AS (SELECT die_id, size, side, count(*) AS n FROM r JOIN s ON k <= size GROUP BY ALL)
    SELECT die_id, size, side, n, round(n / sum(n) OVER (PARTITION BY die_id, size), 9) AS p FROM c""",
    "rolls_by_user",
)
def prefix_histogram(spark, sf_dir):
    return rounded(rolls.prefix_histogram(rolls_by_user(spark, sf_dir), PREFIXES), "p")


@query(
    """, r AS (SELECT *, row_number() OVER (PARTITION BY die_id, size ORDER BY ('0x' || substr(md5('7-' || size || '-' || seq), 1, 8))::BIGINT, seq) AS rk,
      count(*) OVER (PARTITION BY die_id, size) AS total FROM rolls_by_user, (SELECT unnest([16, 32]) AS size)),
    g AS (SELECT die_id, size, side, count(*) AS n FROM r WHERE rk <= size AND total >= size GROUP BY ALL),
    m AS (SELECT die_id, size, sum(n) AS m, count(*) AS k FROM g GROUP BY ALL),
    s AS (SELECT DISTINCT die_id, side FROM rolls_by_user)
    SELECT m.die_id, m.size, s.side, round(coalesce(n, 0) * k / m, 9) AS freq FROM m JOIN s USING (die_id)
    LEFT JOIN g ON g.die_id = m.die_id AND g.size = m.size AND g.side = s.side""",
    "rolls_by_user",
)
def subsample_histogram(spark, sf_dir):
    return rounded(stats.subsample_histogram(rolls_by_user(spark, sf_dir), SUBSAMPLES), "freq")


@query(
    """, r AS (SELECT die_id, side, row_number() OVER (PARTITION BY die_id ORDER BY seq) - 1 AS k, count(*) OVER (PARTITION BY die_id) AS n FROM rolls_by_user),
    d AS (SELECT r.die_id, b, n, ('0x' || substr(md5('7-' || b || '-' || k), 1, 8))::BIGINT % n AS at FROM r, (SELECT unnest(range(0, 20)) AS b)),
    c AS (SELECT d.die_id, d.b, r.side, any_value(d.n) AS size, count(*) AS n FROM d JOIN r ON r.die_id = d.die_id AND r.k = d.at GROUP BY ALL),
    seen AS (SELECT DISTINCT die_id, side, size FROM c),
    filled AS (SELECT seen.die_id, seen.side, seen.size, coalesce(c.n, 0) AS n FROM seen CROSS JOIN (SELECT unnest(range(0, 20)) AS b) bs
      LEFT JOIN c ON c.die_id = seen.die_id AND c.side = seen.side AND c.b = bs.b)
    SELECT die_id, side, round(quantile_cont(n, 0.05) / any_value(size), 9) AS ci_low, round(quantile_cont(n, 0.95) / any_value(size), 9) AS ci_high
    FROM filled GROUP BY die_id, side""",
    "rolls_by_user",
)
def bootstrap_ci_det(spark, sf_dir):
    return rounded(stats.bootstrap_deterministic(rolls_by_user(spark, sf_dir)), "ci_low", "ci_high")


@query()
def bootstrap_ci(spark, sf_dir):
    return stats.bootstrap(rolls_by_flag(spark, sf_dir))


_STEPS = ", s AS (SELECT die_id, lag(side) OVER (PARTITION BY die_id ORDER BY seq) AS from_side, side AS to_side FROM rolls_by_user), t AS (SELECT *, count(*) AS n FROM s WHERE from_side IS NOT NULL GROUP BY ALL) "
_DENSE = _STEPS + """, top AS (SELECT die_id, max(side) AS top FROM rolls_by_user GROUP BY die_id), a AS (SELECT die_id, top, unnest(range(1, top + 1)) AS from_side FROM top),
g AS (SELECT die_id, from_side, unnest(range(1, top + 1)) AS to_side FROM a),
m AS (SELECT die_id, CAST(from_side AS INTEGER) AS from_side, CAST(to_side AS INTEGER) AS to_side, coalesce(n, 0) AS n FROM g LEFT JOIN t USING (die_id, from_side, to_side)) """


@query(_STEPS + "SELECT die_id, from_side, to_side, n FROM t", "rolls_by_user")
def transition_counts(spark, sf_dir):
    return rolls.transitions(rolls_by_user(spark, sf_dir), chunk=256)


@query(_DENSE + "SELECT * FROM m", "rolls_by_user")
def transition_dense(spark, sf_dir):
    return rolls.dense_transitions(rolls_by_user(spark, sf_dir))


@query(_DENSE + "SELECT die_id, from_side, to_side, CAST(coalesce(floor(n * 254 / nullif(max(n) OVER (PARTITION BY die_id), 0)), 0) AS INTEGER) AS grey FROM m", "rolls_by_user")
def transition_grey(spark, sf_dir):
    cells = rolls.dense_transitions(rolls_by_user(spark, sf_dir))
    most = cells.groupBy("die_id").agg(F.max("n").alias("most"))
    return cells.join(most, "die_id").select("die_id", "from_side", "to_side", scalars.grey(F.col("n"), F.col("most")).alias("grey"))


@query(_DENSE + """, c AS (SELECT *, CAST(coalesce(floor(n * 254 / nullif(max(n) OVER (PARTITION BY die_id), 0)), 0) AS INTEGER) AS grey FROM m)
SELECT die_id, from_side, to_side, from_side || '->' || to_side AS move, n || 'x' AS times, CASE WHEN grey > 100 THEN grey - 40 ELSE grey + 40 END AS text_grey FROM c""", "rolls_by_user")
def transition_texts(spark, sf_dir):
    cells = rolls.dense_transitions(rolls_by_user(spark, sf_dir))
    most = cells.groupBy("die_id").agg(F.max("n").alias("most"))
    return cells.join(most, "die_id").select(
        "die_id", "from_side", "to_side", F.concat_ws("->", "from_side", "to_side").alias("move"), F.concat(F.col("n").cast("string"), F.lit("x")).alias("times"),
        scalars.text_grey(scalars.grey(F.col("n"), F.col("most"))).alias("text_grey"),
    )


@query(_DENSE + "SELECT die_id, max(n) AS most FROM m GROUP BY die_id", "rolls_by_user")
def transition_max(spark, sf_dir):
    return rolls.dense_transitions(rolls_by_user(spark, sf_dir)).groupBy("die_id").agg(F.max("n").alias("most"))


def _histogram(spark, sf_dir) -> DataFrame:
    """Histograms with a plain interval, the same in any engine: a tenth of p to either side."""
    h = rolls.relative(rolls.label_counts(rolls_by_flag(spark, sf_dir)))
    return h.select("die_id", "side", "p", (F.col("p") * 0.9).alias("ci_low"), (F.col("p") * 1.1).alias("ci_high"))


_CI = _FLAG + _HIST + ", hist AS (SELECT die_id, side, p, p * 0.9 AS ci_low, p * 1.1 AS ci_high FROM h)"
_PRODUCT = "sum({0}.p * {1}.p) AS p, sum({0}.ci_low * {1}.ci_low) AS ci_low, sum({0}.ci_high * {1}.ci_high) AS ci_high"
_TWO = _CI + ", two AS (SELECT a.side + b.side AS side, " + _PRODUCT.format("a", "b") + " FROM hist a, hist b WHERE a.die_id = 'A' AND b.die_id = 'N' GROUP BY a.side + b.side) "


@query(_TWO + "SELECT side, round(p, 9) AS p, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high FROM two", "rolls_by_flag")
def combine_two(spark, sf_dir):
    h = _histogram(spark, sf_dir)
    return rounded(stats.combine(h.where("die_id = 'A'"), h.where("die_id = 'N'")), "p", "ci_low", "ci_high")


@query(
    _TWO + ", three AS (SELECT two.side + r.side AS side, " + _PRODUCT.format("two", "r") + " FROM two, hist r WHERE r.die_id = 'R' GROUP BY two.side + r.side) "
    "SELECT side, round(p, 9) AS p, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high FROM three",
    "rolls_by_flag",
)
def combine_fold(spark, sf_dir):
    h = _histogram(spark, sf_dir)
    return rounded(stats.combine_all([h.where(F.col("die_id") == d) for d in ("A", "N", "R")]), "p", "ci_low", "ci_high")


_FAIR = ", f AS (SELECT *, 1 / count(*) OVER (PARTITION BY die_id) AS fair FROM hist) "


@query(
    _CI + _FAIR + "SELECT die_id, side, CASE WHEN abs(p - fair) < 0.001 THEN 'within' WHEN p > fair THEN 'more frequent' ELSE 'less frequent' END AS verdict FROM f",
    "rolls_by_flag",
)
def bar_verdict(spark, sf_dir):
    h = _histogram(spark, sf_dir).withColumn("fair", 1 / F.count(F.lit(1)).over(rolls.by_die()))
    return h.select("die_id", "side", scalars.verdict(F.col("p"), F.col("fair")).alias("verdict"))


@query(
    _CI + _FAIR + """, i AS (SELECT *, CAST(trunc(p / fair * 50) AS INTEGER) AS o, CAST(trunc(ci_low / fair * 50) AS INTEGER) AS l, CAST(trunc(ci_high / fair * 50) AS INTEGER) AS r FROM f)
    SELECT die_id, side, printf('%2d %.3f ', side, p) || list_aggregate([CASE WHEN k = o THEN 'o' WHEN k = r THEN ']' WHEN k = l THEN '[' WHEN k = 50 THEN '*'
      WHEN k > l AND k < r THEN '=' WHEN k >= least(50, o) AND k < greatest(50, o) THEN '-' ELSE ' ' END FOR k IN range(0, 1 + greatest(r, 50))], 'string_agg', '') AS line FROM i""",
    "rolls_by_flag",
)
def text_histogram(spark, sf_dir):
    h = _histogram(spark, sf_dir).withColumn("fair", 1 / F.count(F.lit(1)).over(rolls.by_die()))
    return h.select("die_id", "side", scalars.histogram_line(*(F.col(c) for c in ("side", "p", "ci_low", "ci_high", "fair"))).alias("line"))


@query(
    _CHI + """, n AS (SELECT die_id, sum(n) AS n FROM c GROUP BY die_id), p AS (SELECT die_id, CASE WHEN dof <= 0 OR x <= 0 THEN 1.0 ELSE round(greatest(0, 1 - list_sum(list_transform(range(0, 400),
    lambda k: exp((dof / 2 + k) * ln(x / 2) - x / 2 - lgamma(dof / 2 + k + 1))))), 9) END AS p FROM x)
    SELECT die_id, printf('N=%d p=%f (%d%% chance the data is from a random source)', CAST(n AS BIGINT), p, CAST(trunc(100 * p) AS INTEGER)) AS line FROM p JOIN n USING (die_id)""",
    "rolls_by_supplier",
)
def chi2_text(spark, sf_dir):
    r = rolls_by_supplier(spark, sf_dir)
    joined = stats.chi_square(r).join(r.groupBy("die_id").agg(F.count(F.lit(1)).alias("n")), "die_id")
    return joined.select("die_id", scalars.chi2_line(F.col("n"), F.round("p", 9)).alias("line"))


# --- charts ----------------------------------------------------------------------


def _charts(spark) -> DataFrame:
    rows = [("flags", None, ["A", "N", "R"], ["a", "n", "r"]), ("first", 0.02, ["A"], None), ("zero", 0.0, ["N", "A"], ["only one"])]
    return spark.createDataFrame(rows, "chart_id string, fair_value double, data_ids array<string>, names array<string>")


_CHARTS = """, charts(chart_id, fair_value, data_ids, n_names) AS (VALUES ('flags', NULL::DOUBLE, ['A', 'N', 'R'], 3), ('first', 0.02, ['A'], NULL), ('zero', 0.0, ['N', 'A'], 1)),
series AS (SELECT chart_id, unnest(data_ids) AS data_id, unnest(range(0, len(data_ids))) AS pos FROM charts),
rows_ AS (SELECT chart_id, CAST(pos AS INTEGER) AS pos, data_id, side, p, ci_low, ci_high FROM series JOIN hist ON data_id = die_id) """


def _data(spark, sf_dir) -> DataFrame:
    return _histogram(spark, sf_dir).withColumnRenamed("die_id", "data_id")


@query(_CI + _CHARTS + "SELECT chart_id, pos, data_id, side, round(p, 9) AS p FROM rows_", "rolls_by_flag")
def chart_lookup(spark, sf_dir):
    return rounded(charts.lookup(_charts(spark), _data(spark, sf_dir)).select("chart_id", "pos", "data_id", "side", "p"), "p")


@query(_CI + _CHARTS + "SELECT chart_id, data_id FROM series WHERE data_id NOT IN (SELECT die_id FROM hist WHERE die_id <> 'R')", "rolls_by_flag")
def chart_missing(spark, sf_dir):
    return charts.missing_data(_charts(spark), _data(spark, sf_dir).where("data_id != 'R'")).select("chart_id", "data_id")


@query(_CI + _CHARTS + "SELECT chart_id, round(max(ci_high), 9) AS max_y FROM rows_ GROUP BY chart_id", "rolls_by_flag")
def chart_max(spark, sf_dir):
    return rounded(charts.chart_max(charts.lookup(_charts(spark), _data(spark, sf_dir))), "max_y")


@query(
    _CI + _CHARTS + "SELECT chart_id, round(coalesce(nullif(any_value(fair_value), 0), 1 / count(*)), 9) AS fair FROM rows_ JOIN charts USING (chart_id) WHERE pos = 0 GROUP BY chart_id",
    "rolls_by_flag",
)
def chart_fair_value(spark, sf_dir):
    c = _charts(spark)
    return rounded(charts.fair_values(c, charts.lookup(c, _data(spark, sf_dir))), "fair")


@query(
    _CI + _CHARTS + """, pl AS (SELECT *, row_number() OVER (PARTITION BY chart_id, pos ORDER BY side) AS place FROM rows_)
    SELECT chart_id, CAST(place AS INTEGER) AS place, array_to_string(list(printf('%.5f', round(p, 9)) ORDER BY pos), ' ') AS ps FROM pl GROUP BY chart_id, place""",
    "rolls_by_flag",
)
def series_zip(spark, sf_dir):
    rows = charts.by_position(charts.lookup(_charts(spark), _data(spark, sf_dir)))
    return rows.select("chart_id", "place", F.array_join(F.transform("ps", lambda p: F.format_string("%.5f", F.round(p, 9))), " ").alias("ps"))


@query("SELECT side, round(p, 9) AS p, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high FROM (".join([_TWO, ""]) + "SELECT * FROM two UNION ALL SELECT 1, 0.09, 0.09, 0.09)", "rolls_by_flag")
def chart_union_custom(spark, sf_dir):
    h = _histogram(spark, sf_dir)
    custom = spark.createDataFrame([(1, 0.09, 0.09, 0.09)], "side int, p double, ci_low double, ci_high double")
    return rounded(charts.with_custom_rows(stats.combine(h.where("die_id = 'A'"), h.where("die_id = 'N'")), custom), "p", "ci_low", "ci_high")


@query(_CI + "SELECT die_id AS data_id, side, round(CASE WHEN die_id = 'A' THEN p ELSE 0.5 END, 9) AS p FROM hist", "rolls_by_flag")
def first_wins(spark, sf_dir):
    d = _data(spark, sf_dir).select("data_id", "side", "p")
    return rounded(charts.first_wins([d.where("data_id = 'A'"), d.withColumn("p", F.lit(0.5))]), "p")


_GEOMETRY = """, g AS (SELECT *, len(data_ids) AS k, CASE WHEN len(data_ids) > 4 THEN 6 ELSE 12 END AS w, CASE WHEN len(data_ids) > 1 THEN 1 ELSE 3 END AS m FROM charts),
geo AS (SELECT *, CAST(CASE WHEN k > 1 THEN (k + 2) * (w + m) ELSE w + m END AS INTEGER) AS gw FROM g) """


@query(
    _CI + _CHARTS + _GEOMETRY + """, top AS (SELECT chart_id, max(ci_high) AS top FROM rows_ GROUP BY chart_id),
    fv AS (SELECT chart_id, coalesce(nullif(any_value(fair_value), 0), 1 / count(*)) AS fair FROM rows_ JOIN charts USING (chart_id) WHERE pos = 0 GROUP BY chart_id),
    pl AS (SELECT *, row_number() OVER (PARTITION BY chart_id, pos ORDER BY side) - 1 AS place FROM rows_),
    a AS (SELECT pl.*, geo.w, geo.m, geo.gw, top, fair FROM pl JOIN geo USING (chart_id) JOIN top USING (chart_id) JOIN fv USING (chart_id))
    SELECT chart_id, pos, side, CAST(place * gw + 2 * m + w * pos + (pos + 1) * m AS INTEGER) AS x, round(220 * (1 - greatest(p, fair) / top), 6) AS y, w AS width,
      round(220 * abs(p - fair) / top, 6) AS height, place * gw + 2 * m + w * pos + (pos + 1) * m + w / 2 AS whisker_x, round(220 * (1 - ci_low / top), 6) AS low_y,
      round(220 * (1 - ci_high / top), 6) AS high_y, round(220 * (1 - fair / top), 6) AS fair_y,
      CASE WHEN abs(p - fair) < 0.001 THEN 'within' WHEN p > fair THEN 'more' ELSE 'less' END AS verdict, round(100 * (p - fair) / fair, 6) AS off FROM a""",
    "rolls_by_flag",
)
def chart_bars(spark, sf_dir):
    c = _charts(spark)
    out = charts.bars(c, charts.lookup(c, _data(spark, sf_dir)))
    word = F.regexp_extract("verdict", r"is (?:.*% )?(within|more|less)", 1)
    return out.withColumns({k: F.round(k, 6) for k in ("y", "height", "low_y", "high_y", "fair_y", "off")}).withColumns({"verdict": word, "x": F.col("x").cast("int")})


@query(
    _CI + _CHARTS + _GEOMETRY + """, n AS (SELECT chart_id, count(*) AS sides FROM rows_ WHERE pos = 0 GROUP BY chart_id),
    names(chart_id, pos, name) AS (VALUES ('flags', 0, 'a'), ('flags', 1, 'n'), ('flags', 2, 'r'), ('zero', 0, 'only one'))
    SELECT chart_id, pos, name, CAST(sides * gw + 30 AS BIGINT) AS x, 30 + 20 * pos AS y FROM names JOIN n USING (chart_id) JOIN geo USING (chart_id)""",
    "rolls_by_flag",
)
def chart_legends(spark, sf_dir):
    c = _charts(spark)
    return charts.legends(c, charts.lookup(c, _data(spark, sf_dir)))


@query(
    _CI + """SELECT die_id, CAST(row_number() OVER (PARTITION BY die_id ORDER BY side) - 1 AS INTEGER) AS place, side, round(p, 9) AS p, round(ci_low, 9) AS ci_low,
    round(ci_high, 9) AS ci_high FROM hist""",
    "rolls_by_flag",
)
def histogram_json(spark, sf_dir):
    """Written as JSON records, and read back from them."""
    return rounded(charts.from_records(charts.records(_histogram(spark, sf_dir))), "p", "ci_low", "ci_high")


# Measured diameters of a die, as published.
_DIAMETERS = """side\t1\t2\t3\t4\t5\t6\t7\t8\t9\t10
opp\t20\t19\t18\t17\t16\t15\t14\t13\t12\t11
mm\t19.53\t19.60\t19.87\t19.83\t19.36\t19.39\t19.53\t19.33\t19.50\t19.36
dd\t0.0\t0.07\t0.34\t0.3\t-.17\t-.14\t0.0\t-.2\t-.03\t-.17
pside\t1.15\t1.19\t0.71\t1.05\t0.88\t1.14\t1.34\t1.10\t0.92\t0.70
popp\t1.27\t1.14\t1.13\t0.66\t0.79\t1.01\t1.17\t0.96\t0.97\t0.73

free text"""
_MEASURED = ", d AS (SELECT {} FROM (SELECT {})) ".format(
    "unnest(side) AS side, unnest(opp) AS opp, unnest(mm) AS mm, unnest(dd) AS dd, unnest(pside) AS pside, unnest(popp) AS popp",
    ", ".join(f"[{', '.join(x.split(chr(9))[1:])}]::{'INTEGER' if k < 2 else 'DOUBLE'}[] AS {x.split(chr(9))[0]}" for k, x in enumerate(_DIAMETERS.split("\n")[:6])),
)


def _diameters(spark) -> DataFrame:
    return files.parse_diameters(spark.createDataFrame([("d20", _DIAMETERS)], "die_id string, value string"))


@query(
    _FLAG + _MEASURED + """, f AS (SELECT die_id, side, n / avg(n) OVER (PARTITION BY die_id) AS freq FROM c),
    m AS (SELECT a.die_id, a.freq, b.freq AS ofreq, mm FROM d JOIN f a ON a.side = d.side JOIN f b ON b.die_id = a.die_id AND b.side = d.opp)
    SELECT die_id, count(*) AS n, round(corr(dd, freq + ofreq), 8) AS r FROM (SELECT *, mm - avg(mm) OVER (PARTITION BY die_id) AS dd FROM m) GROUP BY die_id""",
    "rolls_by_flag",
)
def opposite_face_corr(spark, sf_dir):
    """Deviation of a measured diameter against the frequency of the faces at its ends."""
    f = rolls.normalized(rolls.label_counts(rolls_by_flag(spark, sf_dir)))
    other = f.select("die_id", F.col("side").alias("opp"), F.col("freq").alias("ofreq"))
    m = f.join(_diameters(spark).select("side", "opp", "mm"), "side").join(other, ["die_id", "opp"])
    m = m.withColumn("dd", F.col("mm") - F.avg("mm").over(rolls.by_die()))
    return m.groupBy("die_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("dd", F.col("freq") + F.col("ofreq")), 8).alias("r"))
