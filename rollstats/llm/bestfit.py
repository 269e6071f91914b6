"""Best-fit packing by a plan over lengths.

A document's ids are one piece, or pieces of the capacity and a last one.  The
histogram of piece lengths has at most as many entries as the capacity, however
many documents there are, and best-fit-decreasing runs over its counts: sequences
with the same room left are one run, and pieces of one length enter a run all at
once (:func:`plan`).  The plan says which ranks within a length go to which
sequences and places there.  Pieces are ranked within their length without a sort: each
task counts its own, and the counts of earlier tasks are added by a join on task and
length.  Only lengths and checksums are shuffled, never texts or ids.

Ids are the named library's.  Its model is asked once for each word, as its pre-tokenizer cuts
them, and gives a word the same ids wherever it stands; what stands between two spaces is
then one look-up.  Parts of texts with characters beyond Latin letters and common punctuation, whose case
and composition have rules of their own, go through the library whole.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, table

CAPACITY = 4096
END_ID = 1
#: Words whose ids a worker keeps, and characters of the longest that it keeps.
WORDS, WORD_CHARS = 500_000, 40
#: Characters that are encoded at once; long texts are cut at a space.
SLICE = 1 << 16
_RANK_BITS = 50


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _ranges(test) -> str:
    """A character class of the plain characters that pass a test."""
    return "".join(re.escape(chr(c)) for c in range(0x180) if test(unicodedata.category(chr(c))[0]))


_SPACE = "\t-\r \x85\xa0"
_LETTER, _NUMBER = _ranges(lambda k: k == "L"), _ranges(lambda k: k == "N")
#: Other characters than those whose lower case and composition are their own business and whose spaces both sides know.
_OTHER = re.compile("[^\\x00-\\x1b\\x20-įı-ſ‐-‧€]")
#: The words of the vocabulary's pre-tokenizer, among the characters that are left.
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")


class _Kept(dict):
    """Ids as bytes; those of strings that are not there yet are made by a function."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        ids = self.make(word)
        if len(word) <= WORD_CHARS:
            if len(self) >= WORDS:
                self.clear()
            self[word] = ids
        return ids


class _Encoder:
    """The library's vocabulary, with the ids of words, and of words that no space separates."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(plain)]
        self.letter = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}
        self.words = _Kept(self.word)
        self.chunks = _Kept(lambda chunk: b"".join(map(self.words.__getitem__, _WORD.findall(chunk))))

    def word(self, word: str) -> bytes:
        letters = word if word.isascii() and word.isalnum() else "".join(map(self.letter.__getitem__, word.encode()))
        ids = [t.id for t in self.library.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=1)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def _slices(text: str) -> Iterator[str]:
    """The text in parts that begin at a space: no word and no composed character spans two."""
    at = 0
    while len(text) - at > SLICE:
        end = text.rfind(" ", at + 1, at + SLICE)
        end = end if end > 0 else text.find(" ", at + SLICE)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def encode(text: str | None, path: str) -> bytes:
    """Ids of the whole text and the end id, each as four little-endian bytes."""
    encoder, out = _encoder(path), []
    for part in _slices(text or ""):
        if "<|" in part or _OTHER.search(part):
            out.append(encoder.whole(part))
        else:
            out += map(encoder.chunks.__getitem__, part.lower().split())
    out.append(END_ID.to_bytes(4, "little"))
    return b"".join(out)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit-decreasing over counts: ``(length, rank, pieces, each, sequence, offset)``.

    Pieces of ``length`` with the ranks ``rank .. rank + pieces - 1`` go, ``each`` to a
    sequence, to ``sequence``, ``sequence + 1`` and so on, from ``offset`` there.  The same
    sequences as best-fit-decreasing piece by piece.  A length splits at most two
    runs and opens at most two, and a run takes at most sqrt(2 * capacity) different
    lengths, so the plan's size is bounded by the capacity alone.
    """
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rooms: list[int] = []  # sorted: room left in some sequences
    out, sequences = [], 0

    def add(room: int, first: int, n: int) -> None:
        if n and room:
            if not runs[room]:
                insort(rooms, room)
            runs[room].append((first, n))

    for length in sorted((c for c in counts if counts[c]), reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                n = -(-left // (capacity // length))
                room, first, sequences = capacity, sequences, sequences + n
            else:
                room = rooms[at]
                first, n = runs[room].pop()
                if not runs[room]:
                    rooms.pop(at)
            each = room // length
            full = min(n, left // each)
            for k, take in ((each, full), (left - full * each, 1)):
                if take and 0 < k <= each and n and left:
                    out.append((length, rank, k * take, k, first, capacity - room))
                    add(room - k * length, first, take)
                    rank, left, first, n = rank + k * take, left - k * take, first + take, n - take
            add(room, first, n)
    return out


def pieces(docs: DataFrame, capacity: int, path: str, id_col: str, text_col: str) -> DataFrame:
    """One row a piece, with the task that made it and its number among that task's pieces of its length; saved."""
    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "part": pa.int64(), "nth": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for b in batches:
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = encode(text.as_py(), path)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    n = len(piece) // 4
                    out.append((doc, k, at // 4, n, zlib.crc32(piece), part, int(made[n])))
                    made[n] += 1
            columns = zip(*out) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return saved(rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"))


def pack_best_fit(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Only documents of more than ``capacity`` ids, the end id included, are cut.  A
    null or empty text is its end id alone; repeated rows are packed as often as they come;
    equal lengths take their slots in the order of tasks and rows; an empty table gives no rows.
    """
    spark = docs.sparkSession
    made = pieces(docs, capacity, path or vocabulary_path(), id_col, text_col)
    by_task = saved(made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    rows = np.array(sorted(plan(counts, capacity)), dtype=np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(rows)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        length, rank, _, each, sequence, offset = shared.value.T
        keys = (length << _RANK_BITS) + rank
        for b in batches:
            own, place = b["length"].to_numpy(), b["rank"].to_numpy()
            at = np.searchsorted(keys, (own << _RANK_BITS) + place, side="right") - 1
            after = place - rank[at]
            b["sequence_id"], b["offset"] = sequence[at] + after // each[at], offset[at] + after % each[at] * own
            yield b.drop(columns="rank")

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = made.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op12_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into few sequences of at most 4096 tokens."""
    return pack_best_fit(table(spark, sf_dir, "documents"))
