"""Source divergence audit: which sources of a language use which words more than the language does.

A term's probability in a group (a source of a language) and in the language is a
smoothed count in billionths; ``f`` is the difference of the two.

* **Counting.** Each task counts terms, and documents that hold them, per group;
  one shuffle by language and term brings the postings of a term together.  Terms of too few
  documents go there.
* **Upper-bound term search** for the terms that a group uses most above its language
  (:func:`top_terms`).  Terms of a group with about the same count are a bucket.  Its largest
  probability in the group, less the smallest that any of its terms has in the language, bounds every ``f`` in it.
  Buckets are evaluated best bound first, in rounds for all groups at once; a group is done
  when the bounds of what it has not seen are strictly below its kth value.
* **Postings compute pairs** (:func:`pair_sums`): the distance of two sources summed over all
  terms is what it would be if no source held a term of the other, from each source's
  histogram of counts, and a correction for each term that both hold, from the term's postings.  Terms
  that neither holds are counted, not visited.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, saved, table

#: Probabilities are integers of this unit; a count is smoothed by PRIOR.
UNIT, PRIOR = 1_000_000_000, 5
#: Different terms that a task holds before it passes their counts on.
HELD = 250_000
#: Counts of fewer are buckets of their own, larger ones STEPS buckets an octave.
EXACT, STEPS = 64, 16
#: Pairs of postings that are handled at once: sums of so many stay exact, and memory bounded.
PAIRS = 1 << 20
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, in lower case, and of characters beyond ASCII."""
    return text.translate(_TERM).split()


def counted(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: partial counts of tasks; ``docs(text, lang, source)`` without nulls."""

    def rows(counts: dict, held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), own in counts.items():
            names, numbers = list(own), np.fromiter(own.values(), dtype=np.int64, count=len(own))
            of = held[lang, source]
            for at in range(0, len(names), 10_000):
                part = names[at : at + 10_000]
                yield pa.RecordBatch.from_pydict({
                    "lang": [lang] * len(part), "source": [source] * len(part), "term": pa.array(part, pa.binary()).cast(pa.string()),
                    "n": numbers[at : at + 10_000], "docs": np.fromiter((of[t] for t in part), dtype=np.int64, count=len(part)),
                })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = defaultdict(Counter), defaultdict(Counter)
        for b in batches:
            for text, lang, source in zip(b.column("text"), b.column("lang").to_pylist(), b.column("source").to_pylist()):
                found = terms(text.as_py())
                counts[lang, source].update(found)
                held[lang, source].update(set(found))
            if sum(map(len, counts.values())) >= HELD:
                yield from rows(counts, held)
                counts, held = defaultdict(Counter), defaultdict(Counter)
        yield from rows(counts, held)

    parts = docs.select(F.col("text").cast("binary").alias("text"), "lang", "source")
    return parts.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def probability(count: Column, total: Column, kept: Column) -> Column:
    """The smoothed probability of a count in units, in exact arithmetic."""
    whole = "decimal(38,0)"
    above, below = F.lit(UNIT).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(20,0)"), (total + PRIOR * kept).cast("decimal(20,0)")
    # The quotient's floor, as a division of whole numbers: the remainder goes first.
    return (F.lit(1) + ((above - above % below).cast(whole) / below).cast("decimal(20,0)")).cast("long")


def postings(docs: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """``(lang, term, source, n, p, q, bucket)`` of the terms that ``min_docs`` documents of a language hold, and ``(lang, source, kept, p0)`` of all groups; both saved.

    ``p`` and ``q`` are a term's probabilities in the group and in the language, ``p0`` is that of
    a term that the group does not hold, ``kept`` the number of terms.
    """
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    # Both aggregations below follow this one shuffle; a term has a row for each task and source.
    dealt = counted(named).repartition("lang", "term")
    term = Window.partitionBy("lang", "term")
    of_term = dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = of_term.withColumns({"docs": F.sum("docs").over(term), "all": F.sum("n").over(term), "first": F.min("source").over(term) == F.col("source")})
    kept = saved(of_term.where(F.col("docs") >= min_docs).drop("docs"))
    languages = kept.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("kept"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = named.select("lang", "source").distinct().join(languages, "lang", "left").join(totals, ["lang", "source"], "left")
    zero = F.lit(0).cast("long")
    groups = groups.na.fill(0, ["kept", "total", "lang_total"])
    groups = saved(groups.withColumn("p0", F.when(F.col("kept") == 0, zero).otherwise(probability(zero, F.col("total"), F.col("kept")))))
    n = F.col("n")
    bucket = F.when(n < EXACT, n).otherwise(EXACT + F.floor(F.log2(n / EXACT) * STEPS).cast("long"))
    known = kept.join(bounded(groups.drop("p0")), ["lang", "source"])
    return saved(known.select(
        "lang", "term", "source", "n", probability(n, F.col("total"), F.col("kept")).alias("p"),
        probability(F.col("all"), F.col("lang_total"), F.col("kept")).alias("q"), bucket.alias("bucket"),
    )), groups


def top_terms(posts: DataFrame, k: int) -> DataFrame:
    """``(lang, source, term, f, rank)``: the ``k`` terms of each group with the largest f above 0, by bounds.

    Ties in f go to the smaller term.  The first round evaluates the buckets that hold the
    first ``k`` terms in order of their bounds, each further round eight times as many; what a bound rules out is never joined.
    """
    group = ["lang", "source"]
    bound = F.max("p") - F.min("q")
    index = posts.groupBy(*group, "bucket").agg(F.count(F.lit(1)).alias("terms"), bound.alias("bound")).where("bound > 0")
    order = Window.partitionBy(*group).orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    index = saved(index.withColumn("before", F.coalesce(F.sum("terms").over(order), F.lit(0))))
    best = Window.partitionBy(*group).orderBy(F.desc("f"), "term")
    found, kth, low, high = None, None, 0, k
    while True:
        unseen = index.where(F.col("before") >= low)
        if kth is not None:
            unseen = unseen.join(bounded(kth), group, "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth")))
        if unseen.isEmpty():
            return found
        chosen = saved(unseen.where(F.col("before") < high).select(*group, "bucket"))
        new = posts.join(bounded(chosen), [*group, "bucket"]).select(*group, "term", (F.col("p") - F.col("q")).alias("f")).where("f > 0")
        new = new if found is None else found.drop("rank").union(new)
        found = saved(new.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
        kth = saved(found.where(F.col("rank") == k).select(*group, F.col("f").alias("kth")))
        low, high = high, 8 * high


_PAIR = "lang string, source string, item string, value long"


def _apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a group adds to its distance from each other source, as if none of its terms were theirs."""
    for b in batches:
        for lang, source, kept, p0, own, others in zip(*(b[c] for c in ("lang", "source", "kept", "p0", "own", "others"))):
            others = [o for o in others if o["source"] != source]
            if not others:
                continue
            own = [] if own is None else own
            p, m = np.array([x["p"] for x in own], dtype=np.int64), np.array([x["m"] for x in own], dtype=np.int64)
            theirs = np.array([o["p0"] for o in others], dtype=np.int64)
            # Sum of m * |p - t| for each t, from running sums over sorted p.
            order = np.argsort(p, kind="stable")
            p, m = p[order], m[order]
            below, mass = np.r_[0, np.cumsum(m)], np.r_[0, np.cumsum(m * p)]
            at = np.searchsorted(p, theirs)
            far = theirs * (2 * below[at] - below[-1]) + mass[-1] - 2 * mass[at]
            gap = np.abs(p0 - theirs)
            names = [o["source"] for o in others]
            yield pd.DataFrame({"lang": lang, "source": source, "item": names, "value": far + gap * (kept - below[-1])})
            yield pd.DataFrame({"lang": lang, "source": names, "item": source, "value": far - gap * below[-1]})


def _together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What pairs of postings of one term change; rows come sorted by language and term."""

    def sums(lang: str, g: pd.DataFrame) -> Iterator[pd.DataFrame]:
        names, who = np.unique(g["source"].to_numpy(dtype=object), return_inverse=True)
        p, p0 = g["p"].to_numpy(), g["p0"].to_numpy()
        begins = np.r_[0, 1 + np.flatnonzero(g["term"].to_numpy()[1:] != g["term"].to_numpy()[:-1]), len(g)]
        sizes, codes, values = np.diff(begins), [], []
        for size in np.unique(sizes[sizes > 1]):
            starts = begins[:-1][sizes == size]
            # Terms of a size together; a term with very many postings alone, in slices of its rows.
            for at in range(0, len(starts), max(1, PAIRS // size**2)):
                rows = starts[at : at + max(1, PAIRS // size**2), None] + np.arange(size)
                for cut in range(0, size, max(1, PAIRS // size)):
                    a, b = rows[:, cut : cut + max(1, PAIRS // size), None], rows[:, None, :]
                    change = np.abs(p[a] - p[b]) - np.abs(p[a] - p0[b]) - np.abs(p0[a] - p[b]) + np.abs(p0[a] - p0[b])
                    code, back = np.unique(np.broadcast_to(who[a] * len(names) + who[b], change.shape), return_inverse=True)
                    value = np.zeros(len(code), dtype=np.int64)
                    np.add.at(value, back.ravel(), change.ravel())
                    codes.append(code)
                    values.append(value)
        if codes:
            code, back = np.unique(np.concatenate(codes), return_inverse=True)
            value = np.zeros(len(code), dtype=np.int64)
            np.add.at(value, back, np.concatenate(values))
            a, b = code // len(names), code % len(names)
            yield pd.DataFrame({"lang": lang, "source": names[a], "item": names[b], "value": value})[a != b]

    def whole(parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, g in pd.concat(parts).groupby("lang", sort=False):
            yield from sums(lang, g)

    held: list[pd.DataFrame] = []
    for b in batches:
        if held and sum(map(len, held)) >= 50_000:
            # The rows of the term that a batch ends in wait for the next one.
            rows = pd.concat(held, ignore_index=True)
            last = (rows["lang"] == rows["lang"].iloc[-1]) & (rows["term"] == rows["term"].iloc[-1])
            if not last.all():
                yield from whole([rows[~last]])
                held = [rows[last]]
        held.append(b)
    if held:
        yield from whole(held)


def pair_sums(posts: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)``: the summed differences of every two sources of a language."""
    own = posts.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m")).groupBy("lang", "source")
    own = own.agg(F.collect_list(F.struct("p", "m")).alias("own"))
    # A language's sources are a list: the result has a row for every two of them.
    others = groups.groupBy("lang").agg(F.collect_list(F.struct("source", "p0")).alias("others"))
    apart = groups.join(own, ["lang", "source"], "left").join(others, "lang").select("lang", "source", "kept", "p0", "own", "others").mapInPandas(_apart, _PAIR)
    rows = posts.join(bounded(groups.select("lang", "source", "p0")), ["lang", "source"]).select("lang", "term", "source", "p", "p0")
    together = rows.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInPandas(_together, _PAIR)
    return apart.union(together).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = 30, k: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(lang, source, part, item, value, rank)``: distances of sources, and the terms that a source uses most above its language.

    Part ``pair``: every other source of the language, the farthest first.  Part
    ``term``: the first ``k`` kept terms of the source with a positive difference.  Ties go to the item
    that is smaller as UTF-8.  Null text, language and source are ''; repeated
    rows are documents of their own; a language without kept terms has pairs of value 0;
    an empty table gives no rows.
    """
    docs = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    posts, groups = postings(docs, min_docs)
    pairs = pair_sums(posts, groups)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    found = top_terms(posts, k)
    if found is None:
        return out
    return out.union(found.select("lang", "source", F.lit("term"), "term", "f", "rank"))


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    """Distances of all sources of a language, and each source's 50 most overused terms."""
    return audit(table(spark, sf_dir, "documents"))


#: The contract in SQL.  Probabilities are divided as HUGEINT, so the floor is exact.
OP13_SQL = r"""
with docs as (
  select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
),
tokens as (select row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
lang_terms as (select lang, term, count(*) as n from tokens group by lang, term having count(distinct row) >= 30),
groups as (select distinct lang, source from docs),
grid as (select g.lang, g.source, t.term, t.n as lang_n from groups g join lang_terms t using (lang)),
own as (select lang, source, term, count(*) as n from tokens group by all),
counts as (select lang, source, term, lang_n, coalesce(o.n, 0) as n from grid left join own o using (lang, source, term)),
sizes as (select *, sum(n) over (partition by lang, source) as total, sum(lang_n) over (partition by lang, source) as lang_total,
  count(*) over (partition by lang, source) as kept from counts),
probabilities as (select lang, source, term, n,
  (1 + (1000000000::hugeint * (n + 5)) // (total + 5 * kept))::bigint as p, (1 + (1000000000::hugeint * (lang_n + 5)) // (lang_total + 5 * kept))::bigint as q from sizes),
pairs as (select a.lang, a.source, b.source as item from groups a join groups b on a.lang = b.lang and a.source <> b.source),
sums as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p))::bigint as value
  from probabilities a join probabilities b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
parts as (
  select lang, source, 'pair' as part, item, coalesce(value, 0) as value from pairs left join sums using (lang, source, item)
  union all select lang, source, 'term', term, p - q from probabilities where n > 0 and p > q
),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from parts)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 50
"""
