"""Benchmark decontamination by template windows, in DataFrame functions only.

Texts become word sequences in which numbers, numbers with units, and names are
typed placeholders, so a question keeps its template when its parameters change.
Windows of placeholders and words are hashed next to the scan and hash-joined
with the benchmark's windows, which are broadcast while their measured size allows
it.  For each candidate the slots are checked: within one copy every parameter of the
benchmark item must stand for one value, and the other way round.

Names are capitalised words inside a sentence.  A copy in one case is found by the
words themselves; one With Every Word Capitalised is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, columns_of, fresh, saved, table

#: Words of a template window.
WINDOW = 8
#: Items of fewer words are matched whole and word for word: so few words are no template.
LEAST = 4
#: Items of more than WINDOW and fewer than three times as many words have windows of this length, as one changed word breaks most of their longer ones.
SHORT_WINDOW = 5
#: Share of an item's windows of WINDOW words that a document must hold.
COVERAGE = 0.5
#: Or the share of its words that matched windows of one copy must cover.
WORDS = 0.6
#: Or the words of an unbroken passage of an item.
RUN = 13
#: Equal windows that follow each other at so many words at most are one chain: lists of numbers, rows of one template.
CHAIN_GAP = 4 * WINDOW

_NAME = "\u0002"
_UNITS = (
    "km cm mm m kg mg g lb lbs oz l ml mi miles? inch(?:es)? feet ft yards? hours? hrs? h minutes? mins? min seconds? secs? s"
    " days? weeks? months? years? dollars? euros? cents? percent usd eur mph kmh gb mb kb"
).split()
_NUMBER = r"\p{N}+(?:[.,:/]\p{N}+)*"
#: Tokens: a marked name, a word, or a number with its unit if it has one.
_TOKEN = rf"{_NAME}?\p{{L}}[\p{{L}}\p{{M}}]*|[$€£]?{_NUMBER}(?:\x20?(?:(?i:{'|'.join(_UNITS)})(?![\p{{L}}])|[%°$€£]))?"
#: A name: a capitalised word inside a sentence.
_INNER_CAPITAL = r"(?<=[\p{L}\p{N},;]\x20)(?=\p{Lu}\p{Ll})"


def tokens(text: Column) -> Column:
    """Words, numbers and names of a text in order; names carry a mark."""
    return F.regexp_extract_all(F.regexp_replace(text, _INNER_CAPITAL, _NAME), F.lit(_TOKEN), F.lit(0))


def is_slot(token: Column) -> Column:
    """True for placeholders: what starts with a mark, a digit or a currency sign."""
    return ~F.substring(token, 1, 1).rlike(r"\p{L}")


def canonical(token: Column) -> Column:
    """The token's template form: lower case, or its placeholder's type."""
    first = F.substring(token, 1, 1)
    # Letters are by far the most frequent, and sorted above all digits: no pattern is run on them.
    return (
        F.when(first == _NAME, F.lit("<name>"))
        .when((first > "9") & ~first.isin("€", "£") & ~first.rlike(r"\p{N}"), F.lower(token))
        .when(token.rlike(r"[^\p{N}.,:/]"), F.lit("<unit>"))
        .otherwise(F.lit("<num>"))
    )


def with_windows(df: DataFrame, hashes: str, sizes: list[int], prefix: str) -> DataFrame:
    """Adds ``{prefix}{size}``: a hash of every run of ``size`` of the ``hashes``, in order; none where there are fewer.

    Runs are joined from runs of powers of two, two numbers at a time: no run is copied out.
    """
    n = F.size(hashes)

    def joined(first: str, second: str, apart: int, length: int) -> Column:
        """Hashes of the pairs of first[i] and second[i + apart], which stand for runs of ``length``."""
        count = F.greatest(n - length + 1, F.lit(0))
        return F.zip_with(F.slice(first, 1, count), F.slice(second, apart + 1, count), lambda x, y: F.xxhash64(x, y))

    powers, k = {1: hashes}, 1
    while 2 * k <= max(sizes):
        powers[2 * k] = f"{prefix}power_{2 * k}"
        df = df.withColumn(powers[2 * k], joined(powers[k], powers[k], k, 2 * k))
        k *= 2
    for size in sizes:
        parts = [p for p in sorted(powers, reverse=True) if size & p]
        run, length = powers[parts[0]], parts[0]
        for p in parts[1:]:
            name = f"{prefix}{size}_{p}"
            df = df.withColumn(name, joined(run, powers[p], length, length + p))
            run, length = name, length + p
        df = df.withColumn(f"{prefix}{size}", F.col(run))
    return df


def as_written(token: Column) -> Column:
    """The token itself in lower case, names as words."""
    return F.lower(F.replace(token, F.lit(_NAME), F.lit("")))


def _hashed(words: Column, form) -> Column:
    return F.transform(words, lambda t: F.xxhash64(form(t)))


def _window_size(n: Column, window: int) -> Column:
    """Words of the windows of an item of ``n`` words."""
    return F.when((n > window) & (n < 3 * window), F.lit(min(window, SHORT_WINDOW))).otherwise(F.least(n, F.lit(window)))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(hash, value, size, item, place, windows)``: every window of every item, as template and as written, and how many the item has.

    A window is there with its names as placeholders and as words (a copy in lower or upper
    case shows no names, and holds the second form), and with a capitalised first word as a
    name, which it looks like in the middle of a sentence.  Items under ``LEAST`` words are one window, as written.
    """
    items = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).dropDuplicates()
    words = tokens(F.coalesce(F.col("text"), F.lit("")))
    items = items.select("item", words.alias("_words")).where(F.size("_words") > 0)
    named = F.when(F.get("_words", F.lit(0)).rlike(r"^\p{Lu}\p{Ll}"), F.concat(F.array(F.concat(F.lit(_NAME), F.get("_words", F.lit(0)))), F.slice("_words", 2, F.size("_words")))).otherwise(F.col("_words"))
    forms = F.array(F.col("_words"), F.transform("_words", lambda t: F.replace(t, F.lit(_NAME), F.lit(""))), named)
    short = F.size("_words") < LEAST
    items = items.select("item", F.explode(F.when(short, F.array(F.col("_words"))).otherwise(forms)).alias("_words"))
    values = _hashed(F.col("_words"), as_written)
    items = items.select("item", values.alias("_values"), F.when(short, values).otherwise(_hashed(F.col("_words"), canonical)).alias("_hashes"))
    items = items.withColumn("size", _window_size(F.size("_hashes"), window))
    lengths = list(range(1, max(window, SHORT_WINDOW) + 1))
    items = with_windows(with_windows(items, "_hashes", lengths, "_w_"), "_values", lengths, "_v_")

    def sized(prefix: str) -> Column:
        out = F.when(F.lit(False), F.array().cast("array<bigint>"))
        for size in lengths:
            out = out.when(F.col("size") == size, F.col(f"{prefix}{size}"))
        return out

    each = items.select("item", "size", F.posexplode(F.arrays_zip(sized("_w_").alias("hash"), sized("_v_").alias("value"))).alias("place", "w"), F.size(sized("_w_")).alias("windows"))
    return each.select("item", "size", "windows", "place", "w.hash", "w.value").distinct()


def chained(rows: DataFrame, keys: list[str], place: str) -> DataFrame:
    """Adds ``first`` and ``last``: a row's number from the start and from the end of its chain.

    A chain holds the rows of equal ``keys`` whose places follow each other within ``CHAIN_GAP``.
    """
    order = Window.partitionBy(*keys).orderBy(place)
    starts = F.coalesce(F.col(place) - F.lag(place).over(order) > CHAIN_GAP, F.lit(True))
    rows = rows.withColumn("chain", F.sum(starts.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*keys, "chain")
    return rows.withColumns({
        "first": F.row_number().over(inside.orderBy(place)), "last": F.row_number().over(inside.orderBy(F.col(place).desc())),
    }).drop("chain")


def matched(seen: DataFrame, keys: DataFrame) -> DataFrame:
    """Hits of the windows ``seen(row, at, hash)`` in items' windows ``keys(hash, size, item, place, windows)``.

    A window that an item holds once is hit wherever it is seen.  One that it holds several times, as a list of numbers
    does, is hit where its number within its chain, from the start or from the end, is that of the window seen within
    its own: as many hits as windows, where all pairs would be their product.
    """
    out = ["row", "item", "size", "windows", "place", (F.col("at") - F.col("place")).alias("shift")]
    own = ["item", "size", "hash"]
    keys = keys.distinct()
    many = keys.groupBy(*own).agg((F.count_distinct("place") > 1).alias("many"))
    keys = saved(chained(keys.join(many, own), own, "place"))
    found = saved(seen.join(bounded(saved(keys.groupBy("hash").agg(F.bool_or("many").alias("any_many")))), "hash"))
    hits = found.join(bounded(saved(keys.where(~F.col("many")))).drop("first", "last"), "hash").select(*out)
    again = saved(keys.where("many"))
    if again.isEmpty():
        return hits
    placed = saved(chained(found.where("any_many").select("row", "at", "hash").distinct(), ["row", "hash"], "at"))
    for number in ("first", "last"):
        hits = hits.union(placed.join(bounded(again), ["hash", number]).select(*out))
    return hits


def contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``(text_key, item, coverage)`` of every text and benchmark item it holds; see :func:`text_key`.

    ``coverage`` is the share of the item's windows, or of its words where too few windows are whole.

    A text holds an item if it has at least
    ``coverage`` of the item's windows, in one alignment, in neighbouring ones or wherever they stand,
    or if windows of one alignment or neighbouring ones cover ``WORDS`` of its words, or one of its
    passages of ``RUN`` words, and the slots of these are consistent.  Of a list longer than the item's (numbers only, rows of
    one template) its first and last part count, and whatever has the item's own values.  Items of fewer than ``LEAST`` words must
    be there word for word.  Null and empty texts and items hold nothing; equal texts are one, repeated items
    count once; null ids of items are left out; an empty benchmark or table gives no rows.
    """
    bench = saved(benchmark_windows(benchmark, window, item_col, item_text_col))
    sizes = sorted(r[0] for r in bench.select("size").distinct().collect())  # at most window
    texts = docs.select(text_key(F.col(text_col)).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if not sizes:
        return texts.select(F.col("row").alias("text_key"), F.lit(None).cast("long").alias("item"), F.lit(0.0).alias("coverage")).where(F.lit(False))
    hashed = texts.withColumn("_words", tokens(F.col("text"))).withColumn("_hashes", _hashed(F.col("_words"), canonical))
    short, other = [s for s in sizes if s < LEAST], [s for s in sizes if s >= LEAST]
    if short:
        hashed = with_windows(hashed.withColumn("_exact", _hashed(F.col("_words"), as_written)), "_exact", short, "_w_")
    if other:
        hashed = with_windows(hashed, "_hashes", other, "_t_")
    runs = [F.col(f"_w_{s}" if s < LEAST else f"_t_{s}") for s in sizes]
    # Places run on from size to size; only differences within one alignment matter.
    seen = hashed.select("row", F.posexplode(F.concat(*runs) if len(runs) > 1 else runs[0]).alias("at", "hash"))
    keys = bench.select("hash", "size", "item", "place", "windows")
    hits = matched(seen, keys)
    # Windows that an item's template repeats are looked up as written, too: a copy of them counts wherever it stands in a longer list.
    repeated = bench.groupBy("item", "size", "hash").agg(F.count_distinct("place").alias("n")).where("n > 1").drop("n")
    written = saved(bench.join(repeated, ["item", "size", "hash"], "left_semi").select(F.col("value").alias("hash"), "size", "item", "place", "windows"))
    if not written.isEmpty():
        lists = bounded(saved(hits.join(bounded(saved(written.select("item").distinct())), "item", "left_semi").select("row").distinct()))
        again = texts.join(lists, "row", "left_semi").groupBy("row").agg(F.first("text").alias("text")).select("row", _hashed(tokens(F.col("text")), as_written).alias("_values"))
        again = with_windows(again, "_values", sizes, "_v_")
        hits = hits.union(matched(again.select("row", F.posexplode(F.concat(*(F.col(f"_v_{s}") for s in sizes))).alias("at", "hash")), written))
    hits = saved(hits.distinct())  # equal texts have equal hits
    groups = saved(_held_groups(hits, window, coverage))
    items = _items(benchmark, item_col, item_text_col)
    slotted = saved(items.where((F.size("item_words") >= LEAST) & F.exists("item_words", is_slot)))
    which = bounded(saved(slotted.select("item").distinct()))
    doubtful = saved(groups.join(which, "item", "left_semi"))
    sound = groups
    if not doubtful.isEmpty():
        sound = groups.join(which, "item", "left_anti").unionByName(_consistent(hits, doubtful, texts, slotted, sizes))
    return sound.groupBy(F.col("row").alias("text_key"), "item").agg(F.max("coverage").alias("coverage"))


def _held_groups(hits: DataFrame, window: int, coverage: float) -> DataFrame:
    """``(row, item, windows, scope, coverage, passage)`` of the groups of alignments that hold enough of an item.

    ``passage`` marks those that only an unbroken passage makes candidates.
    """
    size, n = F.col("size"), F.col("windows") + F.col("size") - 1
    long = F.least(n, F.lit(window))
    more = F.greatest(long - size, F.lit(0))
    # An alignment's places are at most an item's windows.
    lines = hits.groupBy("row", "item", "windows", "size", "shift").agg(F.array_sort(F.collect_set("place")).alias("places"))
    # Places at which an unbroken run of so many windows ends: the run up to each place, in order.
    runs = F.aggregate(
        "places", F.array().cast("array<struct<place:int,run:int>>"),
        lambda out, p: F.concat(out, F.array(F.struct(
            p.alias("place"),
            F.when((F.size(out) > 0) & (F.element_at(out, -1)["place"] == p - 1), F.element_at(out, -1)["run"] + 1).otherwise(F.lit(1)).alias("run"),
        ))),
    )
    lines = lines.withColumn("runs", runs).withColumn("run", F.array_max(F.transform("runs", lambda r: r["run"])) + size - 1)
    # Each window covers its words; the last one of a run of enough windows is the end of a long one.
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + size - 1))))
    ends = F.transform(F.filter("runs", lambda r: r["run"] > more), lambda r: r["place"])
    each = lines.select(
        "row", "item", "windows", "size", "run", "shift", F.explode(F.transform(covered, lambda w: F.struct(w.alias("word"), F.array_contains(ends, w).alias("long")))).alias("c")
    )
    found = each.select("row", "item", "windows", "size", "run", _scopes(), "c.*").groupBy("row", "item", "windows", "size", "scope").agg(
        F.count_distinct("word").alias("words"), F.count_distinct(F.when(F.col("long"), F.col("word"))).alias("n"), F.max("run").alias("run"),
    )
    share, words = F.col("n") / (n - long + 1), F.col("words") / n
    whole = F.col("scope.kind") == "all"
    enough = (share >= coverage) | (~whole & (n > window) & (words >= WORDS))
    return found.where(enough | (F.col("scope.kind") == "one") & (F.col("run") >= RUN)).select(
        "row", "item", "windows", "scope", F.when(share >= coverage, share).otherwise(words).alias("coverage"), (~enough).alias("passage")
    )


def _scopes() -> Column:
    """The groups of alignments that are judged together, exploded as ``scope``.

    Each alignment by itself; those whose shifts differ by less than the item's
    length, which a copy with words put in or left out has (two rows of buckets, half
    a bucket apart); and all of the row, which a copy in another order has.  Two whole
    copies that do not overlap never share a bucket.
    """
    shift, n = F.col("shift"), F.col("windows") + F.col("size") - 1
    scope = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.cast("long").alias("key"))
    return F.explode(F.array(
        scope("all", F.lit(0)), scope("one", shift), scope("near", F.floor(shift / n)), scope("next", F.floor((shift + n / 2) / n)),
    )).alias("scope")


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    texts = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).dropDuplicates()
    return texts.select("item", tokens(F.coalesce(F.col("text"), F.lit(""))).alias("item_words"))


def _consistent(hits: DataFrame, doubtful: DataFrame, texts: DataFrame, items: DataFrame, sizes: list[int]) -> DataFrame:
    """Those of the candidate groups whose slots do not contradict each other.

    Every parameter of the item must stand for one value, and every value for one
    parameter, so a copy of the item's own words is always consistent.
    A passage alone must also have as many plain words as slots, or the item's own
    values: thirteen numbers in a row are the template of any others.  Other groups must have one plain
    word, or the item's own values.  Only these candidates' texts are read again, once, and only matched words compared.
    """
    rows = bounded(saved(doubtful.select("row").distinct()))
    # Equal texts are read as one: the first of each is as good as any.
    once = texts.join(rows, "row", "left_semi").groupBy("row").agg(F.first("text").alias("text"))
    words = saved(once.select("row", tokens(F.col("text")).alias("words")))
    n = F.size("words")
    # at -> first word: places of the sizes before this one are taken off.
    before, start = F.lit(0), F.lit(None).cast("int")
    for s in sizes:
        start = F.when(F.col("size") == s, F.col("at") - before + 1).otherwise(start)
        before = before + F.greatest(n - s + 1, F.lit(0))
    aligned = (
        hits.join(doubtful.select("row", "item").distinct(), ["row", "item"], "left_semi").withColumn("at", F.col("shift") + F.col("place"))
        .join(words, "row").join(bounded(items), "item")
    )
    pairs = aligned.select(
        "row", "item", "windows", "size", "shift",
        F.explode(F.arrays_zip(
            F.slice("item_words", F.col("place") + 1, F.col("size")).alias("theirs"), F.slice("words", start, F.col("size")).alias("ours"),
            F.sequence(F.col("place"), F.col("place") + F.col("size") - 1).alias("word"),
        )).alias("p"),
    ).select("row", "item", "windows", "size", "shift", "p.*").distinct()
    scoped = pairs.select("row", "item", "windows", _scopes(), "word", as_written(F.col("theirs")).alias("theirs"), as_written(F.col("ours")).alias("ours"), is_slot(F.col("theirs")).alias("slot"))
    keys = ["row", "item", "windows", "scope"]
    lower = saved(scoped.join(doubtful.select(keys), keys, "left_semi").distinct())
    slots = lower.where("slot").select(*keys, "theirs", "ours").distinct()
    one_way = slots.groupBy(*keys, "theirs").count().where("count > 1").select(keys)
    other = slots.groupBy(*keys, "ours").count().where("count > 1").select(keys)
    strange = lower.groupBy(keys).agg(F.avg(F.col("slot").cast("double")).alias("share"), F.bool_or(F.col("slot") & (F.col("theirs") != F.col("ours"))).alias("other"))
    strange = doubtful.join(strange.where("other"), keys).where((F.col("share") == 1) | (F.col("passage") & (F.col("share") > 0.5))).select(keys)
    return doubtful.join(one_way.union(other).union(strange).distinct(), keys, "left_anti")


def text_key(text: Column) -> Column:
    """128 bits of a text's content; null counts as empty.  A key that is the same in every scan, which a row number is not."""
    return F.md5(F.coalesce(text, F.lit("")))


def clean_of(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; columns stay as they are.

    Rows with a null or empty text stay; equal texts stay or go together; an empty
    benchmark keeps all rows.
    """
    key = fresh(docs, "_key")
    bad = contaminated(docs, benchmark, text_col=text_col, **options).select(F.col("text_key").alias(key)).distinct()
    return docs.withColumn(key, text_key(F.col(text_col))).join(bounded(saved(bad)), key, "left_anti").select(*columns_of(docs))


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items it holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    each = found.groupBy("text_key").agg(
        F.array_sort(F.collect_set("item")).alias("items"), F.round(F.max("coverage"), 6).alias("max_coverage")
    )
    return docs.select("doc_id", text_key(F.col("text")).alias("text_key")).join(bounded(saved(each)), "text_key", "left").select(
        "doc_id", F.col("items").isNotNull().alias("contaminated"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce(F.array_join(F.col("items").cast("array<string>"), ","), F.lit("")).alias("items"),
        F.coalesce("max_coverage", F.lit(0.0)).alias("coverage"),
    )
