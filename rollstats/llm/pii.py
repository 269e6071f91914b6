"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose spans: strict ones (the rules, which always stay) and loose ones.
Five labelers vote on each proposal: regex (a rule holds), checksum (Luhn, octets,
digit counts), gazetteer (top-level domains, issuers, dialling codes), context (cue
words before it) and shape (what it touches).  Votes are counted by pattern over
all documents; expectation-maximisation on these counts estimates how reliable
each labeler is, without any true label; the resulting probabilities are the soft
labels that train the final classifier over votes and length.  Loose spans that
it accepts are added.

Only counts leave the executors: at most ``kinds * 3 ** labelers * lengths`` rows,
whatever the input.  Texts are searched once, and never shuffled.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import any_of, columns_of, saved, span_string, table

#: In the order of the contract.
KINDS = ("email", "ip", "card", "phone")

# The rules of the contract. Repetitions are possessive and a
# run is entered at its start only, which gives the same leftmost matches
# in linear time and without recursion on very long runs.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
RULES = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser patterns, whose spans the classifier judges: mail addresses spelt out, IPv6, cards of 15 digits or with a wrong digit, and
#: numbers without a country code.  They also meet dates, versions and other numbers, which teach what is not personal.
_HEX = "[0-9A-Fa-f]{1,4}"
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++(?:\x20?[\[({{]\x20?(?i:at)\x20?[\])}}]\x20?|\x20(?:at|AT|@)\x20){_HOST}++(?:(?:\.|\x20?[\[({{]\x20?(?i:dot)\x20?[\])}}]\x20?|\x20(?:dot|DOT|\.)\x20){_HOST}++)++",
    "ip": rf"(?<![0-9A-Za-z:.])(?:{_HEX}(?::{_HEX}){{7}}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?:[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{3,4}|[0-9]{4}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.,/:-])(?:00[1-9][0-9]{0,2}[\x20-]|\([0-9]{2,5}\)\x20?|0[0-9]{1,4}[\x20/.-]|[0-9]{3}[\x20.-])[0-9]{2,8}(?:[\x20.-][0-9]{2,4}){0,4}(?![0-9])",
}
_DOMAINS = "com net org edu gov mil int info biz io co ai dev app de fr es it uk us ca eu ch at nl be pl pt se br mx in jp cn au".split()
_DIAL_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 61 62 63 64 65 66 81 82 84 86 90 91".split()
_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
_CUES = {
    "email": r"(?i)(?:e-?mail|mailto|contact|correo|courriel|write to)",
    "ip": r"(?i)(?:\bip\b|address|host|server|login from|adresse|direcci)",
    "card": r"(?i)(?:card|visa|mastercard|amex|karte|carte|tarjeta|credit)",
    "phone": r"(?i)(?:phone|\btel|call|mobile|fax|whatsapp|t[ée]l[ée]fono|telefon|\bcell)",
}
#: Dates and years look like numbers without a country code.
_DATE = r"^\(?[0-9]{1,2}[./-][0-9]{1,2}[./-](?:[0-9]{2}|[0-9]{4})$|^0?[0-9]{3}[ ][0-9]{2,3}$"
_COUNTER_CUES = r"(?i)(?:version|\bdate|\bdatum|\bfecha|\bsince\b|\bpage\b|\bmeet\b|\blook\b|\bisbn|\bissn|order (?:no|id)|invoice|\bsku|\bdoi|serial|build)"
#: Characters before a span in which cue words count.
CONTEXT = 32
LABELERS = ("regex", "checksum", "gazetteer", "context", "shape")


#: Elements that are folded together, and characters of a block of text.
FOLD, BLOCK = 256, 512


def let(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once, however often it is used, in lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, op, first: int) -> Column:
    """For each element of an array of numbers, ``op`` over those before it, from ``first``.

    A fold that appends to an array copies it at every step.  So chunks of FOLD elements are
    folded, then the chunks' results, and each chunk starts from what comes before it: near linear
    time for arrays of millions.  ``op`` is a sum or a maximum.
    """
    none = F.array().cast("array<int>")

    def fold(of: Column, number) -> Column:
        start = F.struct(F.lit(first).alias("at"), none.alias("out"))
        return F.aggregate(of, start, lambda s, x: F.struct(op(s["at"], number(x)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))

    def chunked(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / FOLD).cast("int")), lambda k: fold(F.slice(v, k * FOLD + 1, FOLD), lambda x: x))

    def joined(chunks: Column) -> Column:
        before = fold(chunks, lambda c: c["at"])["out"]
        return F.flatten(F.zip_with(chunks, before, lambda c, b: F.transform(c["out"], lambda x: op(x, b))))

    return let(values, lambda v: F.when(F.size(v) > 0, let(chunked(v), joined)).otherwise(none))


def blocks(text: Column) -> Column:
    """The text in blocks of BLOCK characters: the way to a place in a string is as long as what lies before it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}+"), F.lit(0))


def part(of: Column, at: Column, n: Column) -> Column:
    """``n`` characters from place ``at`` on of a text in :func:`blocks`."""
    begin = F.floor(at / BLOCK).cast("int")
    near = F.array_join(F.slice(of, begin + 1, F.floor((at + n) / BLOCK).cast("int") - begin + 1), "")
    return F.substring(near, at - begin * BLOCK + 1, n)


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as ``struct(start, end, m)``, in code points, end exclusive.

    The pieces between the matches give the places: both functions walk the
    text with the same matcher.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int,m:string>>")

    def placed(pairs: Column) -> Column:
        before = running(F.transform(pairs, lambda p: F.length(p["gap"]) + F.length(p["m"])), lambda a, b: a + b, 0)
        start = lambda p, at: at + F.length(p["gap"])
        return F.zip_with(pairs, before, lambda p, at: F.struct(start(p, at).alias("start"), (start(p, at) + F.length(p["m"])).alias("end"), p["m"].alias("m")))

    # The piece after the last match has none.
    pairs = lambda m: F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), m.alias("m")), lambda p: p["m"].isNotNull())
    return let(found, lambda m: F.when(F.size(m) > 0, let(pairs(m), placed)).otherwise(none))


def clear_of(loose: Column, rules: Column) -> Column:
    """The loose proposals that overlap no rule span.

    In the order of rules' starts and loose spans' ends, a loose span overlaps one if the largest end of the rules before
    it lies beyond its start.
    """

    def events(xs: Column, key: str, rule: int) -> Column:
        return F.transform(xs, lambda x: F.struct(x[key].alias("key"), F.lit(rule).alias("rule"), (x["end"] * rule).alias("end"), x.alias("x")))

    def kept(both: Column) -> Column:
        ends = running(F.transform(both, lambda e: e["end"]), F.greatest, 0)
        free = F.filter(F.arrays_zip(both.alias("e"), ends.alias("top")), lambda z: (z["e"]["rule"] == 0) & (z["top"] <= z["e"]["x"]["start"]))
        return F.transform(free, lambda z: z["e"]["x"])

    both = F.array_sort(F.concat(events(rules, "start", 1), events(loose, "end", 0)))
    return F.when((F.size(rules) > 0) & (F.size(loose) > 0), let(both, kept)).otherwise(loose)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if a string of digits passes the Luhn check."""

    def value(c: Column, k: Column) -> Column:
        d = c.cast("int")
        double = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(k % 2 == 1, double).otherwise(d)

    each = F.transform(F.split(F.reverse(number), "(?<=.)(?=.)", -1), value)
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0


def _octets(m: Column) -> Column:
    """True if no part exceeds 255, leading zeros aside."""
    return F.forall(
        F.split(m, r"\.", -1),
        lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3)
        & (F.coalesce(F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int"), F.lit(999)) <= 255),
    )


def holds(kind: str, m: Column) -> Column:
    """The contract's condition on a match of the kind's rule."""
    n = F.length(digits(m))
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: _octets(m),
        "card": lambda: F.when(n.between(16, 19), luhn(digits(m))).otherwise(False),
        "phone": lambda: n.between(8, 15),
    }[kind]()


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(kind: str, strict: bool, text: Column, s: Column) -> Column:
    """The proposal, of a text in blocks, with every labeler's vote: 1 for personal data, -1 against, 0 none."""
    m, n = s["m"], F.length(digits(s["m"]))
    number = digits(m)
    start = F.greatest(s["start"] - CONTEXT, F.lit(0))
    before = part(text, start, s["start"] - start)
    after = part(text, s["end"], F.lit(1))
    checksum = {
        "email": _vote(m.rlike("[A-Za-z]"), ~m.rlike("[A-Za-z]")),
        "ip": _vote(_octets(m), ~_octets(m)) if strict else _vote(m.rlike("[0-9]"), ~m.rlike("[0-9]")),
        "card": _vote(luhn(number), ~luhn(number)),
        "phone": _vote(n.between(9, 13), (n < 9) | (n > 15)),
    }[kind]
    top = F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)[^A-Za-z0-9-]*$", 1))
    gazetteer = {
        "email": _vote(top.isin(_DOMAINS), top.rlike("^[0-9]+$")),
        "ip": _vote(~m.rlike(r"^(?:0|127|255)\."), m.rlike(r"^0\.")) if strict else _vote(m.rlike(r"(?i)^(?:2[0-9a-f]{3}|fe[89ab][0-9a-f]|f[cd][0-9a-f]{2}):"), ~m.rlike("::") & m.rlike("^[0-9]{1,2}:")),
        "card": _vote(number.rlike(_ISSUERS), ~number.rlike(_ISSUERS)),
        "phone": _vote(any_of([number.startswith(c) for c in _DIAL_CODES]), number.startswith("0")) if strict else _vote(~m.rlike(_DATE) & number.rlike("^(?:0[1-9]|00|[2-9])"), m.rlike(_DATE) | number.rlike("^1")),
    }[kind]
    touches = "[\\p{L}\\p{N}_]"
    return F.struct(
        F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("rank"), s["start"].alias("start"), s["end"].alias("end"),
        F.lit(1 if strict else 0).alias("regex"), checksum.alias("checksum"), gazetteer.alias("gazetteer"),
        _vote(before.rlike(_CUES[kind]), before.rlike(_COUNTER_CUES)).alias("context"),
        _vote(~F.right(before, F.lit(1)).rlike(touches) & ~after.rlike(touches), F.right(before, F.lit(1)).rlike(touches) & after.rlike(touches)).alias("shape"),
        F.least(F.floor((s["end"] - s["start"]) / 8), F.lit(4)).cast("int").alias("length"),
    )


def with_proposals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``_rules`` and ``_loose``: arrays of proposals. Loose ones lie outside every rule span."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Cheap conditions first: most texts have no digit and no sign that a pattern needs.
    number = text.rlike("[0-9]")
    needs = {
        ("email", True): text.contains("@"), ("ip", True): number, ("card", True): number, ("phone", True): text.contains("+"),
        ("email", False): text.rlike(r"(?i)[\[({]\x20?at\x20?[\])}]|\x20dot\x20|\x20@\x20"), ("ip", False): text.contains(":"), ("card", False): number, ("phone", False): number,
    }
    empty = F.array().cast("array<struct<start:int,end:int,m:string>>")

    def proposals(strict: bool) -> dict[str, Column]:
        return {f"_{kind}_{strict:d}": F.when(needs[kind, strict], located(text, p)).otherwise(empty) for kind, p in (RULES if strict else LOOSE).items()}

    # One row of a generated array: what is in it is computed once, whatever reads it.
    each = F.struct(*(c.alias(name) for name, c in (proposals(True) | proposals(False)).items()))
    out = docs.select("*", F.explode(F.array(each)).alias("_each"))
    some = any_of([F.size(f"_each.{name}") > 0 for name in (*proposals(True), *proposals(False))])
    out = out.select("*", F.explode(F.array(F.when(some, blocks(text)))).alias("_blocks"))

    def of_kind(kind: str, strict: bool) -> Column:
        spans = F.col(f"_each._{kind}_{strict:d}")
        if strict:
            spans = F.filter(spans, lambda s: holds(kind, s["m"]))
        return F.transform(spans, lambda s: votes(kind, strict, F.col("_blocks"), s))

    def voted(strict: bool) -> Column:
        return F.concat(*(of_kind(kind, strict) for kind in KINDS))

    out = out.select("*", F.explode(F.array(F.struct(voted(True).alias("rules"), voted(False).alias("loose")))).alias("_voted"))
    return out.withColumns({"_rules": F.col("_voted.rules"), "_loose": clear_of(F.col("_voted.loose"), F.col("_voted.rules"))}).drop("_each", "_blocks", "_voted")


# --- the label model and the classifier: plain arithmetic on bounded counts ----


def estimate(patterns: dict[tuple, float], rounds: int = 30) -> tuple[dict[tuple, float], dict]:
    """EM on counted vote patterns ``(kind, vote, ..., length)``.

    A proposal is personal data with a probability of its kind; given that,
    labelers vote independently.  A labeler that abstains (0) says nothing: no
    proposal counts as less likely because a labeler does not know its form.  Returns each pattern's probability, and the
    reliabilities: (kind, labeler, truth) to the probabilities of votes -1 and 1.
    """
    chance = {p: min(0.95, max(0.05, 0.5 + 0.15 * sum(p[1 : 1 + len(LABELERS)]))) for p in patterns}
    tables: dict = {}
    for _ in range(rounds):
        prior: dict = defaultdict(lambda: [1.0, 1.0])
        tables = defaultdict(lambda: {-1: 0.5, 1: 0.5})
        for p, n in patterns.items():
            for truth, share in ((1, chance[p]), (0, 1 - chance[p])):
                prior[p[0]][truth] += n * share
                for name, vote in zip(LABELERS, p[1:]):
                    if vote:
                        tables[p[0], name, truth][vote] += n * share
        tables = {k: {v: c / sum(t.values()) for v, c in t.items()} for k, t in tables.items()}
        for p in patterns:
            odds = math.log(prior[p[0]][1] / prior[p[0]][0])
            for name, vote in zip(LABELERS, p[1:]):
                if vote:
                    odds += math.log(tables[p[0], name, 1][vote] / tables[p[0], name, 0][vote])
            chance[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return chance, tables


def train(patterns: dict[tuple, float]) -> dict[str, float]:
    """Log-odds of ``kind``, and of each of its feature values, from the soft labels of :func:`estimate`."""
    chance, _ = estimate(patterns)
    mass: dict = defaultdict(lambda: [0.5, 0.5])
    names = (*LABELERS, "length")
    for p, n in patterns.items():
        for truth, share in ((1, chance[p]), (0, 1 - chance[p])):
            mass[p[0],][truth] += n * share
            for name, value in zip(names, p[1:]):
                if value or name == "length":
                    mass[p[0], name, value][truth] += n * share
    out = {}
    for key, (no, yes) in mass.items():
        prior = mass[key[0],]
        if len(key) == 1:
            out[key[0]] = math.log(yes / no)
        else:
            out["|".join(map(str, key))] = math.log(yes / no) - math.log(prior[1] / prior[0])
    return out


def count_patterns(proposed: DataFrame) -> dict[tuple, float]:
    fields = ["kind", *LABELERS, "length"]
    rows = proposed.select(F.explode(F.concat("_rules", "_loose")).alias("p")).groupBy(*(F.col(f"p.{f}").alias(f) for f in fields)).count()
    return {tuple(r[:-1]): float(r[-1]) for r in rows.collect()}  # kinds * 3 ** labelers * lengths rows at most


def score(model: dict[str, float], p: Column) -> Column:
    """The classifier's log-odds for a proposal; unseen values say nothing."""
    if not model:
        return F.lit(0.0)
    table_ = F.create_map(*(x for k, v in sorted(model.items()) for x in (F.lit(k), F.lit(v))))
    out = F.coalesce(F.element_at(table_, p["kind"]), F.lit(0.0))
    for name in (*LABELERS, "length"):
        key = F.concat_ws("|", p["kind"], F.lit(name), p[name].cast("string"))
        out = out + F.coalesce(F.element_at(table_, key), F.lit(0.0))
    return out


def find_pii(
    docs: DataFrame, min_probability: float = 0.8, text_col: str = "text", rules_col: str = "pii_rules", spans_col: str = "pii_spans",
    columns: list[str] | None = None,
) -> DataFrame:
    """``docs`` with ``pii_rules`` and ``pii_spans``: arrays of ``struct(rank, start, end, kind)`` by kind, then start.

    ``pii_rules`` are the rules' spans; ``pii_spans`` also hold the loose spans
    that the trained classifier gives ``min_probability``.  Offsets count code
    points, ends are exclusive.  Null and empty texts have no spans.  Rows and
    all other columns, or those of ``columns``, stay as they are (columns of the two names are replaced);
    an empty table gives no rows.  The texts are searched once: proposals are stored with the columns that stay.
    """
    others = [c for c in (docs.columns if columns is None else columns) if c.lower() not in (rules_col.lower(), spans_col.lower())]
    # The row travels as one value: helper columns can't clash with its columns.
    packed = docs.select(F.struct(*columns_of(docs, others)).alias("doc"), F.col(text_col).alias("text"))
    proposed = saved(with_proposals(packed).select("doc", "_rules", "_loose"))
    model = train(count_patterns(proposed))
    limit = math.log(min_probability / (1 - min_probability))
    plain = lambda p: F.struct(p["rank"].alias("rank"), p["start"].alias("start"), p["end"].alias("end"), p["kind"].alias("kind"))
    added = F.filter("_loose", lambda p: score(model, p) >= limit)
    return proposed.select(
        "doc.*",
        F.array_sort(F.transform("_rules", plain)).alias(rules_col),
        F.array_sort(F.transform(F.concat("_rules", added), plain)).alias(spans_col),
    )


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in angle brackets; of overlapping spans the first counts.

    Pieces of the text are taken from its blocks and joined once: linear time in text and spans.
    """
    named = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))

    def pieces(ordered: Column) -> Column:
        # The text from the largest end before a span to its start, then the span's mark; a span that begins before that end has none.
        before = running(F.transform(ordered, lambda s: s["end"]), F.greatest, 0)
        kept = F.filter(F.arrays_zip(ordered.alias("s"), before.alias("at")), lambda z: z["s"]["start"] >= z["at"])

        def piece(of: Column, z: Column) -> Column:
            return F.concat(part(of, z["at"], z["s"]["start"] - z["at"]), F.lit("<"), F.upper(z["s"]["kind"]), F.lit(">"))

        last = F.array_max(F.transform(ordered, lambda s: s["end"]))
        return let(blocks(text), lambda of: F.concat(F.array_join(F.transform(kept, lambda z: piece(of, z)), ""), part(of, last, F.length(text) - last)))

    return F.when(F.size(spans) > 0, let(F.array_sort(named), pieces)).otherwise(text)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document, with digests of the rules' spans."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), columns=["doc_id"])
    count = lambda k: F.size(F.filter("pii_rules", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *(count(k) for k in KINDS), F.sha2(span_string(F.col("pii_rules")), 256).alias("base_sha256"),
        span_string(F.col("pii_spans")).alias("spans"),
    )
