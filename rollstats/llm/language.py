"""Language identification with bit-sliced Bloom filters of character n-grams.

One Bloom filter a language, stored slot by slot: a slot is a bit mask with one
bit a language, so one look-up (the AND of ``HASHES`` slots) returns all languages
whose training texts hold the n-gram.  A text's n-grams are looked up, the bits
of each language are counted, the counts are corrected for the filter's false
positives, and the language with the largest corrected share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, table

GRAM = 4
HASHES = 2
SLOT_BITS = 20
UNKNOWN = "und"
#: Characters that are handled at once; bounds a task's memory whatever the texts' lengths.
_CHUNK = 1 << 18
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
_SECOND = np.uint64(0xFF51AFD7ED558CCD)
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def _grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of a run of characters, and at which places one starts."""
    codes = np.where(_is_letter()[codes], codes, 0).astype(np.uint64)
    n = max(0, len(codes) - GRAM + 1)
    view = [codes[k : k + n] for k in range(GRAM)]
    full = (view[1] != 0) & (view[2] != 0)
    single = (view[0] == 0) & (view[1] != 0) & (view[2] == 0)
    hashed = view[0] * _MIX[0] + view[1] * _MIX[1] + view[2] * _MIX[2]
    hashed += np.where(single, np.uint64(0), view[3] * _MIX[3])
    hashed ^= hashed >> np.uint64(29)
    keep = full | single
    return hashed[keep], keep


def _bordered(text: str | None) -> str:
    return f"\0{text.lower()}\0\0" if text else ""


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of the texts, and where each text's begin.

    Letters are lower-cased; every other character is a border.  An n-gram is a
    run of GRAM characters whose inner ones are letters, so words carry their
    ends; a one-letter word gives border, letter, border.
    """
    parts = [_bordered(t) for t in texts]
    begins = np.r_[0, np.cumsum([len(p) for p in parts], dtype=np.int64)]
    hashed, keep = _grams(_code_points("".join(parts)))
    # Three borders lie between two texts, so no kept n-gram spans both.
    before = np.r_[0, np.cumsum(keep)]
    return hashed, before[np.minimum(begins, len(keep))]


def _slices(text: str) -> Iterator[np.ndarray]:
    """The n-gram codes of a long text, slice by slice, each n-gram once."""
    whole = _bordered(text)
    for at in range(0, len(whole) - GRAM + 1, _CHUNK):
        yield _grams(_code_points(whole[at : at + _CHUNK + GRAM - 1]))[0]


def slots(codes: np.ndarray) -> list[np.ndarray]:
    shift = np.uint64(64 - SLOT_BITS)
    return [((codes * _SECOND) >> shift).astype(np.int64), ((codes * _MIX[0] + _MIX[2]) >> shift).astype(np.int64)]


@dataclass
class Model:
    """languages: by bit; masks: the bit-sliced filters, a row of slots for every WORD languages; noise: false positive rates."""

    languages: list[str]
    masks: np.ndarray
    noise: np.ndarray

    def holds(self, grams: np.ndarray, bit: int) -> np.ndarray:
        """1 where the filter of the language at ``bit`` holds an n-gram, given the looked-up masks."""
        kind = grams.dtype.type
        return grams[bit // WORD] >> kind(bit % WORD) & kind(1)


#: Languages that one mask holds.
WORD = 64


def fit(rows: list[tuple[str, str]], min_texts: int = 2) -> Model:
    """Filters from (language, text) pairs: n-grams that at least ``min_texts`` texts of a language hold."""
    languages = sorted({lang for lang, _ in rows})
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    masks = np.zeros((-(-len(languages) // WORD), 1 << SLOT_BITS), dtype=kind)
    for bit, lang in enumerate(languages):
        own = [np.unique(gram_codes([t])[0]) for other, t in rows if other == lang]
        seen, times = np.unique(np.concatenate(own), return_counts=True)
        grams = seen[times >= min(min_texts, len(own))]
        for s in slots(grams):
            masks[bit // WORD, s] |= kind(1 << bit % WORD)
    model = Model(languages, masks, np.zeros(len(languages)))
    fill = np.array([model.holds(masks, b).mean() for b in range(len(languages))])
    return Model(languages, masks, fill**HASHES)


def _hits(model: Model, codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Of each text's n-grams how many each language's filter holds; a row a language."""
    a, b = slots(codes)
    hit = model.masks[:, a] & model.masks[:, b]
    counts = np.zeros((len(model.languages), len(begins) - 1))
    some = np.flatnonzero(np.diff(begins))
    if len(some):
        for bit in range(len(model.languages)):
            counts[bit, some] = np.add.reduceat(model.holds(hit, bit), begins[some], dtype=np.int64)
    return counts


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score (the corrected share of known n-grams, 0 to 1) of each text."""
    labels, scores = [], []
    at = 0
    while at < len(texts):
        if len(texts[at] or "") > _CHUNK:
            end, counts, total = at + 1, np.zeros((len(model.languages), 1)), np.zeros(1, dtype=np.int64)
            for codes in _slices(texts[at]):
                counts += _hits(model, codes, np.array([0, len(codes)]))
                total += len(codes)
        else:
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= _CHUNK):
                size += len(texts[end] or "")
                end += 1
            codes, begins = gram_codes(texts[at:end])
            counts, total = _hits(model, codes, begins), np.diff(begins)
        share = np.divide(counts, total, out=np.zeros_like(counts), where=total > 0)
        noise = model.noise[:, None]
        share = np.clip((share - noise) / np.maximum(1 - noise, 1e-9), 0, 1)
        for k in range(end - at):
            if total[k] == 0 or not model.languages:
                labels.append(UNKNOWN)
                scores.append(0.0)
            else:
                best = int(share[:, k].argmax())
                labels.append(model.languages[best])
                scores.append(float(share[best, k]))
        at = end
    return labels, scores


def held_out(id_col: str = "doc_id") -> Column:
    """The contract's split: rows that training never sees."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(
    docs: DataFrame, fit_texts: int = 1500, fit_total: int = 12_000, fit_chars: int = 100_000_000, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang",
) -> Model:
    """A model from rows with a language outside the held-out third.

    ``fit_texts`` bounds, in expectation, the texts of each language, and
    ``fit_total`` those of all, and ``fit_chars`` their characters (a hash of the id chooses them;
    a rare language is taken whole).  No labelled row gives a model that answers ``und``.
    """
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r[0]: (r[1], max(r[2], 1)) for r in rows.groupBy("lang").agg(F.count(F.lit(1)), F.sum(F.length("text"))).collect()}
    if not sizes:
        return Model([], np.zeros((0, 1 << SLOT_BITS), dtype=np.uint8), np.zeros(0))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    chosen = F.lit(False)
    for lang, (n, chars) in sorted(sizes.items()):
        limit = int((1 << 30) * min(1.0, min(fit_texts, fit_total / len(sizes)) / n, fit_chars / len(sizes) / chars))
        chosen = chosen | ((F.col("lang") == lang) & (place < limit))
    got = rows.where(chosen).orderBy("id").select("lang", "text").toPandas()
    return fit(list(zip(got["lang"], got["text"])))


def identify(docs: DataFrame, model: Model, text_col: str = "text", label_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` (which replace columns of those names).

    Null texts and texts without a letter get ``und`` and 0.  Ties go to the
    language that sorts first.  Whole texts are read, whatever their length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<label:string,score:double>")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            labels, scores = predict(shared.value, t.tolist())
            yield pd.DataFrame({"label": labels, "score": scores})

    judged = fresh(docs, "_judged")
    out = docs.withColumn(judged, judge(F.col(text_col)))
    return out.withColumns({label_col: F.col(f"{judged}.label"), score_col: F.col(f"{judged}.score")}).drop(judged)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
