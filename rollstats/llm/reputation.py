"""URL filtering: rules, and empirical-Bayes host reputation, in DataFrame functions only.

Labelled page outcomes (bad or not) are counted by host, registered domain and
suffix.  Each level's bad rate is shrunk towards its parent's by a beta-binomial
prior whose strength is estimated from all counts of the level by moments.  A
host is blocked where a lower bound of its posterior bad rate exceeds the overall
rate by a factor: it is credibly worse than the web at large.  Rules come before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, saved, table

# The rules of the contract, (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Width of the posterior bound in standard deviations, and how many times the overall bad rate it must exceed for a block.
BOUND, LIMIT = 1.645, 1.1
#: Second labels under which countries register domains.
_SECOND = "ac co com edu go gob gov ne net or org".split()


def with_host(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``; both empty for a null url or one without ``://``."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    # All after the first ://, cut off by position: no pattern has to cross it.
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return df.withColumn("_rest", rest).withColumns({
        "host": F.translate(F.regexp_extract("_rest", r"^([^/?#]*)", 1), _UPPER, _LOWER),
        "path": F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1),
    }).drop("_rest")


def name_of(host: Column) -> Column:
    """The host without its port."""
    return F.regexp_replace(host, ":[0-9]*$", "")


def _is_address(name: Column) -> Column:
    return name.rlike(r"^(?:[0-9]+(?:\.[0-9]+){3}|\[.*\])$")


def suffix(host: Column) -> Column:
    """The public suffix: the last label, or two where countries register below a second one; of an address, itself."""
    name = name_of(host)
    two = name.rlike(rf"\.(?:{'|'.join(_SECOND)})\.[a-z]{{2}}$")
    return F.when(_is_address(name), name).when(two, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))


def domain(host: Column) -> Column:
    """The registered domain: the suffix and one label more; of an address, itself."""
    name = name_of(host)
    two = name.rlike(rf"\.(?:{'|'.join(_SECOND)})\.[a-z]{{2}}$")
    return F.when(_is_address(name), name).when(two, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def matching_rule(rules=RULES) -> Column:
    """``struct(size, rule, verdict)`` of the longest rule that fits ``host`` and ``path``; null if none does."""
    if not rules:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    fits = [
        F.when(
            ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path),
            F.struct(F.lit(len(host + path)).alias("size"), F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, host, path in rules
    ]
    return F.array_max(F.array(*fits))


def _level(counts: DataFrame, key: str) -> DataFrame:
    return counts.groupBy(key).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def prior_strength(level: DataFrame, p: float) -> float:
    """Alpha + beta of the beta-binomial that the level's units follow.

    With rate p over all N outcomes in k units, the weighted square sum S of the
    units' rates has mean p(1-p)[(k-1) + rho (N - sum n^2 / N - (k-1))]; rho is
    solved for and kept within [0.001, 0.9]; strength = 1 / rho - 1.
    """
    spread, units, total, squares = level.agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - p, 2)),
        F.count(F.lit(1)), F.sum("n"), F.sum(F.col("n").cast("double") * F.col("n")),
    ).first()
    rho, var = 0.001, p * (1 - p)
    if units and var > 0 and (free := total - squares / total - (units - 1)) > 0:
        rho = (spread / var - (units - 1)) / free
    return 1 / min(0.9, max(0.001, rho)) - 1


def host_reputation(outcomes: DataFrame, hosts: DataFrame) -> DataFrame:
    """``(host, n, mean, low, overall)`` for every distinct ``hosts.host``.

    ``outcomes`` holds ``host`` and ``bad`` (0 or 1; null rows don't count).
    ``mean`` is the posterior bad rate, ``low`` its lower bound.  Hosts without
    outcomes take their domain's rate, domains their suffix's, suffixes the
    overall one; without any outcome the overall rate is 0.5.
    """
    counts = saved(
        outcomes.where(F.col("bad").isNotNull() & F.col("host").isNotNull()).groupBy("host")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    )
    split = counts.select("host", domain(F.col("host")).alias("domain"), suffix(F.col("host")).alias("suffix"), "n", "bad")
    by_domain, by_suffix = saved(_level(split, "domain")), saved(_level(split, "suffix"))
    overall = float(counts.agg(F.coalesce(F.sum("bad") / F.sum("n"), F.lit(0.5))).first()[0])
    host_k, domain_k, suffix_k = (F.lit(prior_strength(x, overall)) for x in (counts, by_domain, by_suffix))
    p = F.lit(overall)
    suffix_rate = by_suffix.select("suffix", ((F.col("bad") + suffix_k * p) / (F.col("n") + suffix_k)).alias("suffix_rate"))
    domains = by_domain.withColumn("suffix", suffix(F.col("domain"))).join(bounded(saved(suffix_rate)), "suffix")
    domain_rate = saved(domains.select("domain", ((F.col("bad") + domain_k * F.col("suffix_rate")) / (F.col("n") + domain_k)).alias("domain_rate")))
    known = hosts.select("host").distinct().withColumns({"domain": domain(F.col("host")), "suffix": suffix(F.col("host"))})
    joined = (
        known.join(counts, "host", "left").join(bounded(domain_rate), "domain", "left").join(bounded(saved(suffix_rate)), "suffix", "left")
        .withColumn("prior", F.coalesce("domain_rate", "suffix_rate", p))
    )
    n, bad = F.coalesce("n", F.lit(0)), F.coalesce("bad", F.lit(0))
    a, b = bad + host_k * F.col("prior"), n - bad + host_k * (1 - F.col("prior"))
    return joined.select("host", n.cast("long").alias("n"), a.alias("a"), b.alias("b")).select(
        "host", "n", (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"),
        F.sqrt(F.col("a") * F.col("b") / (F.pow(F.col("a") + F.col("b"), 2) * (F.col("a") + F.col("b") + 1))).alias("deviation"),
    ).withColumns({"low": F.col("mean") - BOUND * F.col("deviation"), "overall": p})


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict, reputation)`` of every row of ``pages``.

    ``outcomes`` holds ``page_id`` and ``bad``; a page's outcome counts once, as
    bad if any of its rows says so.  The longest fitting rule decides; without
    one a host is blocked where the lower posterior bound of its bad rate
    exceeds ``limit`` times the overall rate.  Null urls have an empty host, judged like any other.
    Repeated rows are repeated; ids without an outcome, and null ids, are
    unlabelled; an empty table gives no rows.
    """
    at = saved(with_host(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))).drop("url"))
    once = outcomes.where("page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    labelled = at.select("page_id", "host").where("page_id is not null").dropDuplicates().join(once, "page_id")
    known = bounded(saved(host_reputation(labelled, at)))
    rule = matching_rule(rules)
    return at.join(known, "host", "left").select(
        "page_id", "host", "path", rule["rule"].alias("rule"),
        F.coalesce(rule["verdict"], F.when(F.col("low") > limit * F.col("overall"), "block").otherwise("allow")).alias("verdict"),
        F.round("mean", 9).alias("reputation"),
    )


def op10_url_reputation(spark, sf_dir: str) -> DataFrame:
    """Every page's verdict. Outcomes: labelled pages of low quality or toxic text are bad."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad")
    )
    return judge_urls(table(spark, sf_dir, "pages"), labels)


OP10_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), located AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), outcome AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), named AS (
  SELECT host, regexp_replace(host, ':[0-9]*$', '') AS name FROM (SELECT DISTINCT host FROM located)
), placed AS (
  SELECT host, CASE WHEN regexp_matches(name, '^([0-9]+(\.[0-9]+){3}|\[.*\])$') THEN name
      WHEN regexp_matches(name, '\.(ac|co|com|edu|go|gob|gov|ne|net|or|org)\.[a-z]{2}$') THEN array_to_string(list_slice(string_split(name, '.'), -3, -1), '.')
      ELSE array_to_string(list_slice(string_split(name, '.'), -2, -1), '.') END AS domain,
    CASE WHEN regexp_matches(name, '^([0-9]+(\.[0-9]+){3}|\[.*\])$') THEN name
      WHEN regexp_matches(name, '\.(ac|co|com|edu|go|gob|gov|ne|net|or|org)\.[a-z]{2}$') THEN array_to_string(list_slice(string_split(name, '.'), -2, -1), '.')
      ELSE list_extract(string_split(name, '.'), -1) END AS suffix
  FROM named
), counts AS (
  SELECT host, any_value(domain) AS domain, any_value(suffix) AS suffix,
    count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad
  FROM (SELECT DISTINCT page_id, host FROM located WHERE page_id IS NOT NULL) JOIN outcome USING (page_id) JOIN placed USING (host) GROUP BY host
), by_domain AS (SELECT domain, any_value(suffix) AS suffix, sum(n) AS n, sum(bad) AS bad FROM counts GROUP BY domain),
by_suffix AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM counts GROUP BY suffix),
overall AS (SELECT coalesce(sum(bad) / sum(n), 0.5) AS p FROM counts),
levels AS (SELECT 'host' AS lv, n, bad FROM counts UNION ALL SELECT 'domain', n, bad FROM by_domain UNION ALL SELECT 'suffix', n, bad FROM by_suffix),
moments AS (
  SELECT lv, sum(n * (bad / n - p) ** 2) AS s, count(*) AS k, sum(n) AS total, sum(n * n) AS squares, max(p) * (1 - max(p)) AS v
  FROM levels, overall GROUP BY lv
), strength AS (
  SELECT lv, 1 / least(0.9, greatest(0.001, CASE WHEN v > 0 AND total - squares / total - (k - 1) > 0
    THEN (s / v - (k - 1)) / (total - squares / total - (k - 1)) ELSE 0.001 END)) - 1 AS m FROM moments
), sr AS (
  SELECT suffix, (bad + m * p) / (n + m) AS rate FROM by_suffix, overall, strength WHERE lv = 'suffix'
), dr AS (
  SELECT domain, (bad + m * rate) / (n + m) AS rate FROM by_domain JOIN sr USING (suffix), strength WHERE lv = 'domain'
), posterior AS (
  SELECT known.host, coalesce(counts.bad, 0) + m * coalesce(dr.rate, sr.rate, p) AS a,
    coalesce(counts.n, 0) - coalesce(counts.bad, 0) + m * (1 - coalesce(dr.rate, sr.rate, p)) AS b
  FROM placed AS known LEFT JOIN counts ON known.host = counts.host LEFT JOIN dr ON known.domain = dr.domain LEFT JOIN sr ON known.suffix = sr.suffix,
    overall, strength WHERE lv = 'host'
), judged AS (
  SELECT host, a / (a + b) AS mean, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) AS low FROM posterior
), ruled AS (
  SELECT located.*, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM located
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN low > 1.1 * (SELECT p FROM overall) THEN 'block' ELSE 'allow' END AS verdict,
  round(mean, 9) AS reputation
FROM ruled LEFT JOIN judged USING (host)
"""
