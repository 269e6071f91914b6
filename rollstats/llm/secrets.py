"""Secret scan: rules, and character Markov models compared by likelihood ratio.

One pass over the texts finds the rule spans and the tokens outside them, and counts
character pairs for two labelled samples.  Random strings are what the rules found,
and strings drawn from the usual alphabets, as the rules know few of them.  Ordinary
are all other words, and identifiers joined from them as programs and paths do, with
numbers, dates and versions; tokens that could be secrets carry no label.  Counts are
only ever added, so they do not depend on how rows are dealt; they are summed over all
documents, at most ``SYMBOLS ** 2`` numbers a label.  Two first-order Markov models
follow from them; a token whose log-likelihood ratio says "random" becomes a span of
its own.  No text is shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, span_string, table

# The rules of the contract.
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "markov")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Log-likelihood ratio, in all and a character, from which a token counts as random.
MIN_SCORE, MIN_MEAN = 12.0, 0.4
#: A token that the models judge: a run of secret characters of this length at least, outside every rule span.
MIN_TOKEN = 16
_TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}")
#: Long tokens with a digit or a capital inside could be secrets: they carry no label.
_MIXED = re.compile(r"[0-9]|[a-z0-9+/_=-][A-Z]")
_WORD = re.compile(r"[A-Za-z]{2,}")
#: One labelled identifier is made of so many words of every text.
EVERY = 15
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
#: Symbol 0 stands for every other character: it starts and ends tokens.
SYMBOLS = len(_ALPHABET) + 1
_CODE = np.zeros(1 << 16, dtype=np.int32)
_CODE[[ord(c) for c in _ALPHABET]] = np.arange(1, SYMBOLS)


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    return _CODE[np.minimum(codes, 0xFFFF)]


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the rules' spans in code points, by start, then kind."""
    found = []
    lower = text.lower()
    if any(k in lower for k in _KEYWORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def secret_part(text: str, span: tuple[int, int, int]) -> str:
    """The random string in a rule span: for assignments, the value."""
    start, end, kind = span
    return ASSIGN.match(text, start, end)[2] if kind == 0 else text[start:end]


def outside(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of what lies between the spans, in order."""
    at = 0
    for start, end, _ in spans:
        if start > at:
            yield at, start
        at = max(at, end)
    if at < len(text):
        yield at, len(text)


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens for the models, and parts of tokens, outside every rule span."""
    return [m.span() for start, end in outside(text, spans) for m in _TOKEN.finditer(text, start, end)]


def ordinary_text(text: str, spans: list[tuple[int, int, int]], tokens: list[tuple[int, int]]) -> str:
    """The text without rule spans and without tokens that could be secrets."""
    unlabelled = [(s, e, 3) for s, e in tokens if _MIXED.search(text, s, e)]
    return " ".join(text[s:e] for s, e in outside(text, sorted([*spans, *unlabelled])))


def identifiers(text: str) -> str:
    """Labelled ordinary identifiers: of every ``EVERY`` words three, joined as programs and paths join them.

    The shape, and the numbers, dates and versions in it, follow from the words alone.
    """
    words = _WORD.findall(text)
    out = []
    for a, b, c in zip(words[::EVERY], words[1::EVERY], words[2::EVERY]):
        x = zlib.crc32(f"{a} {b} {c}".encode())
        n, year, month, day = x % 997, 1990 + x % 50, 1 + x % 12, 1 + x % 28
        a, b, c, B, C = a.lower(), b.lower(), c.lower(), b.capitalize(), c.capitalize()
        out.append((
            f"{a}{B}{C}", f"{a}_{b}_{c}", f"{a}-{b}-{c}", f"{a.capitalize()}{B}{n}{C}", f"{a}/{year}/{month:02}/{day:02}/{b}-{c}",
            f"{a}_{b}_{c}".upper(), f"{a}/{b}_{year}{month:02}{day:02}_{n:04}", f"{a[:4].upper()}{n}{b}{c[:3].upper()}{a.capitalize()}",
            f"{a}_{b}_{year}_v{n % 30}", f"{a}={b}-{n}", f"{a}+{b}/{c}{n}", f"{a}{B}V{n % 10}{C}",
        )[x // 1000 % 12])
    return " ".join(out)


def random_strings(n: int = 400, seed: int = 0) -> list[str]:
    """Labelled random strings: ``n`` of each usual alphabet, which the rules' matches may lack."""
    rng = np.random.default_rng(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    kinds = (lower + upper + digits, lower + upper + digits + "+/", lower + upper + digits + "_-", lower + digits, upper + digits, digits + "abcdef", lower, upper)
    return ["".join(rng.choice(list(kind), int(size))) for kind in kinds for size in rng.integers(MIN_TOKEN, 64, n)]


#: Words of programs, for labelled ordinary identifiers that do not depend on what the corpus is about.
_LEXICON = (
    "abstract access account action address agent alpha array async attribute author backup base batch binary blog boolean branch buffer build button byte"
    " cache call char check class client cloud cluster code collection column command commit common config connection container content context count create"
    " data database date default delete detail device document domain driver element encoding encryption entry error event example execution"
    " factory feature field file filter folder format function gateway get handler hash header height host http image index input instance integer"
    " interface internal item iterator java job key label language layout length level library limit list load local log long manager map master max message"
    " method min mode model module name network node number object operation option order output package page parameter parser password path pattern photo"
    " pool position process profile project property protocol proxy python query queue random range read record region registry release remote report request"
    " resource response result retry root route row schema screen script search server service session setting signature singleton size source"
    " spark sql state status storage stream string style system table task template test text thread time title transaction type update upload"
    " user util value variable version view width window write"
).split()


def lexicon_text(n: int = 6000, seed: int = 1) -> str:
    """``n`` identifiers from the lexicon, dates, and rulers."""
    rng = np.random.default_rng(seed)
    words = " ".join(rng.choice(_LEXICON, EVERY * n))
    times = (f"{1990 + k % 50}{c}{1 + k % 12:02}{c}{1 + k % 28:02}{c}{k % 24:02}{c}{k % 60:02}" for k in range(n // 20) for c in "-_/")
    return " ".join([identifiers(words), words, *times, *(c * 40 for c in "=-_+/" for _ in range(n // 200))])


def pair_counts(text: str) -> np.ndarray:
    """Counts of neighbouring symbols, flattened; the text is bordered by symbol 0."""
    s = np.r_[0, symbols(text), 0]
    return np.bincount(s[:-1] * SYMBOLS + s[1:], minlength=SYMBOLS * SYMBOLS)


def transitions(counts: np.ndarray, smoothing: float = 0.5) -> np.ndarray:
    """First-order model: the probability of each next symbol."""
    c = counts.reshape(SYMBOLS, SYMBOLS).astype(np.float64) + smoothing
    return c / c.sum(axis=1, keepdims=True)


def log_odds(random: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each transition, random over ordinary.

    Ordinary is an even mixture of the corpus' model and the lexicon's.
    """
    return np.log(transitions(random)) - np.log((transitions(ordinary) + transitions(pair_counts(lexicon_text()))) / 2)


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())])
_FOUND = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("token", pa.string())])
_SCAN = pa.schema([
    ("doc_id", pa.int64()), ("is_doc", pa.bool_()), ("spans", pa.list_(_SPAN)), ("tokens", pa.list_(_FOUND)),
    ("label", pa.int32()), ("pair", pa.list_(pa.int32())), ("n", pa.list_(pa.int64())),
])
_SCAN_DDL = "doc_id long, is_doc boolean, spans array<struct<start:int,end:int,kind:int>>, tokens array<struct<start:int,end:int,token:string>>, label int, pair array<int>, n array<long>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, SYMBOLS * SYMBOLS), dtype=np.int64)
    for b in batches:
        rows = []
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
            text = text.as_py() or ""
            spans = rule_spans(text)
            tokens = candidates(text, spans)
            if spans:
                counts[1] += pair_counts(" ".join(secret_part(text, s) for s in spans))
            rest = ordinary_text(text, spans, tokens)
            counts[0] += pair_counts(f"{rest} {identifiers(rest)}")
            rows.append({
                "doc_id": doc_id, "is_doc": True, "spans": [{"start": s, "end": e, "kind": k} for s, e, k in spans],
                "tokens": [{"start": s, "end": e, "token": text[s:e]} for s, e in tokens],
            })
        yield pa.RecordBatch.from_pylist(rows, schema=_SCAN)
    at = [np.flatnonzero(c) for c in counts]
    yield pa.RecordBatch.from_pylist([{"is_doc": False, "label": k, "pair": x.tolist(), "n": counts[k][x].tolist()} for k, x in enumerate(at)], schema=_SCAN)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rule spans and candidate tokens of every document, and the partitions' pair counts; saved."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return saved(rows.mapInArrow(_scan, _SCAN_DDL))


def fit(scanned: DataFrame) -> np.ndarray:
    """The log-odds table from the pair counts of all documents."""
    pairs = scanned.where(~F.col("is_doc")).select("label", F.explode(F.arrays_zip("pair", "n")).alias("c"))
    total = pairs.groupBy("label", F.col("c.pair").alias("pair")).agg(F.sum("c.n").alias("n"))
    counts = np.zeros((2, SYMBOLS * SYMBOLS))
    for label, pair, n in total.collect():  # 2 * SYMBOLS ** 2 rows at most
        counts[label, pair] = n
    if counts[1].any():  # without any labelled secret there is nothing to tell apart
        counts[1] += pair_counts(" ".join(random_strings()))
    return log_odds(counts[1], counts[0])


def is_random(odds: np.ndarray, token: str, min_score: float, min_mean: float) -> bool:
    """True if the likelihood ratio says that the token is random."""
    s = np.r_[0, symbols(token), 0]
    score = odds[s[:-1], s[1:]].sum()
    return bool(score >= min_score and score >= min_mean * len(token))


def find_secrets(
    docs: DataFrame,
    min_score: float = MIN_SCORE,
    min_mean: float = MIN_MEAN,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, spans)``: spans as structs (start, end, kind) by start, then kind.

    Offsets count code points, ends are exclusive.  ``markov`` spans are tokens, or
    parts of tokens, of ``MIN_TOKEN`` characters or more outside rule spans whose
    log-likelihood ratio is at least ``min_score``, and ``min_mean`` a character: both
    models are trained on all documents, and without any rule span (no labelled
    secret) no token is added.  Null and empty texts have no spans; repeated rows
    are repeated; an empty table gives no rows; other columns are not read.
    """
    scanned = scan(docs, id_col, text_col)
    odds = fit(scanned)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            out = [
                [{"start": t["start"], "end": t["end"]} for t in tokens if is_random(odds, t["token"], min_score, min_mean)]
                for tokens in b.column("tokens").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("spans"), pa.array(out, kind)], names=["doc_id", "spans", "more"])

    judged = scanned.where("is_doc").select("doc_id", "spans", "tokens").mapInArrow(
        judge, "doc_id long, spans array<struct<start:int,end:int,kind:int>>, more array<struct<start:int,end:int>>"
    )
    names = F.array(*(F.lit(k) for k in KINDS))
    ranked = F.concat("spans", F.transform("more", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(len(KINDS) - 1).alias("kind"))))
    ordered = F.array_sort(F.transform(ranked, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("rank"), s["end"].alias("end"))))
    named = F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["rank"]).alias("kind")))
    return judged.select("doc_id", named.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from :func:`find_secrets`' spans."""
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *(count(k) for k in KINDS[:3]), F.sha2(span_string(base), 256).alias("base_sha256"), span_string(F.col("spans")).alias("spans")
    )


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets in every document, with digests of the rules' spans."""
    return digest(find_secrets(table(spark, sf_dir, "documents")))
