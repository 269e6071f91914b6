"""Sequence packing by Karmarkar-Karp multiway differencing.

A document's ids are cut where a full window fills; what is left over is one
long piece and a few short ones from its end, of falling sizes (``TRIMS``): long
pieces alone can't be balanced to less than a few hundredths of a window, the
short ones even it out.  Full windows are sequences of their own.  Pieces are
dealt by a hash into groups of about ``group_windows`` windows, or ``group_pieces`` pieces if that is less, and each group is
partitioned by largest differencing: every piece starts as a partial partition (its size, and zeros), the two partial partitions with the
largest imbalance are merged with opposing orders, until one partition is left
whose windows are nearly equal.  If one exceeds the capacity, the group gets a
window more.  Only piece lengths and checksums are shuffled, never texts or ids.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, table

CAPACITY = 2048
END_ID = 1
#: Sizes of the short pieces at a document's end; each is cut off what has four times its size left.
TRIMS = (256, 64, 16, 4)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def _encoder(path: str):
    """The vocabulary file in a library that encodes in near-linear time, special strings included.

    Ids of a byte-level BPE are its merge ranks, so the file's vocabulary,
    with its printable stand-ins turned back into bytes, is a rank table.  The ids
    are those of the library that the file is made for (tests compare both).
    """
    import public_tokenizers
    import tiktoken

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in word): i for word, i in file["model"]["vocab"].items() if word not in special}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


#: White space as the pattern of the vocabulary knows it, in runs that are too long for a pattern with a look-ahead.
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def _parts(text: str, encoder) -> Iterator[np.ndarray]:
    """Ids of a text, part by part.

    A long run of white space is one word of the pattern: all of it where the text
    or a special string ends it, all but its last character where something else follows. So it
    is encoded by itself, and what stands before and after it as a text of its own.
    """
    at = 0
    for run in _RUN.finditer(text):
        end = run.end()
        if end < len(text) and not text.startswith(tuple(encoder.special_tokens_set), end):
            end -= 1
        yield encoder.encode_to_numpy(text[at : run.start()], allowed_special="all")
        yield np.array(encoder._encode_single_piece(text[run.start() : end]), dtype="<u4")
        at = end
    yield encoder.encode_to_numpy(text[at:], allowed_special="all")


def encode(text: str | None, path: str) -> np.ndarray:
    """Ids of the whole text, then the end id."""
    parts = list(_parts(text, _encoder(path))) if text else []
    return np.concatenate([*parts, [END_ID]]).astype("<u4")


def cuts(n: int, capacity: int, trims: tuple[int, ...] = TRIMS) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows, a long piece, short ones at the end."""
    out = [(at, capacity) for at in range(0, n - n % capacity, capacity)]
    left, short = n % capacity, []
    for t in trims:
        if left >= 4 * t:
            short.append(t)
            left -= t
    at = n - n % capacity
    for size in (left, *short):
        if size:
            out.append((at, size))
            at += size
    return out


def differencing(sizes: list[int], windows: int) -> np.ndarray:
    """The window of each piece, by Karmarkar-Karp multiway differencing."""
    n = len(sizes)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    sums: list[np.ndarray] = []
    made: list[tuple[int, int, np.ndarray] | None] = []
    heap = []
    for k, size in enumerate(sizes):
        first = np.zeros(windows, dtype=np.int64)
        first[0] = size
        sums.append(first)
        made.append(None)
        heap.append((-size, k))
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        merged = sums[a] + sums[b][::-1]
        order = np.argsort(-merged, kind="stable")
        merged = merged[order]
        sums.append(merged)
        made.append((a, b, order))
        sums[a] = sums[b] = None
        heapq.heappush(heap, (int(merged[-1] - merged[0]) if windows > 1 else 0, len(sums) - 1))
    out = np.zeros(n, dtype=np.int64)
    todo = [(heap[0][1], np.arange(windows))]
    while todo:
        node, slots = todo.pop()
        if made[node] is None:
            out[node] = slots[0]
            continue
        a, b, order = made[node]
        before = np.empty(windows, dtype=np.int64)
        before[order] = slots
        todo += [(a, before), (b, before[::-1])]
    return out


def pack_group(sizes: list[int], capacity: int) -> np.ndarray:
    """The window of each piece; the fewest windows from the bound up for which differencing fits."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        window = differencing(sizes, windows)
        if not len(sizes) or np.bincount(window, weights=sizes).max() <= capacity:
            return window
        windows += 1


def tokenized(docs: DataFrame, capacity: int, trims: tuple[int, ...], path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its piece boundaries and the checksum of each piece's ids; saved."""
    schema = "doc_id long, doc_tokens long, starts array<long>, lengths array<long>, crcs array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")][1:]
        kinds = [pa.int64(), *[pa.list_(pa.int64())] * 3]
        for b in batches:
            out = []
            for text in b.column("text"):
                ids = encode(text.as_py(), path)
                pieces = cuts(len(ids), capacity, trims)
                out.append((
                    len(ids), [s for s, _ in pieces], [n for _, n in pieces],
                    [zlib.crc32(ids[s : s + n].tobytes()) for s, n in pieces],
                ))
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=["doc_id", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return saved(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    trims: tuple[int, ...] = TRIMS,
    group_windows: int = 128,
    group_pieces: int = 4096,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row a piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Every id of every row, the end id included, lies in exactly one piece.  A
    null or empty text is its end id alone.  Repeated rows are packed as often
    as they come.  Sequences of one full piece have ids from 0, the others
    negative ids; offsets in a sequence are gapless from 0.  An empty table
    gives no rows.
    """
    path = path or vocabulary_path()
    pieces = tokenized(docs, capacity, trims, path, id_col, text_col).select(
        "doc_id", "row", "doc_tokens", F.explode(F.arrays_zip("starts", "lengths", "crcs")).alias("p")
    ).select(
        "doc_id", F.col("p.starts").alias("start"), F.col("p.lengths").alias("length"),
        F.col("p.crcs").alias("ids_crc32"), "doc_tokens", "row",
    )
    full = (
        pieces.where(F.col("length") == capacity).drop("row")
        .withColumn("sequence_id", F.monotonically_increasing_id())
        .withColumn("offset", F.lit(0).cast("long"))
    )
    rest = pieces.where(F.col("length") < capacity)
    size, count = rest.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    # Differencing keeps a row of sums a piece, so a group is bounded by its windows and by its pieces.
    groups = max(1, size // (capacity * group_windows), count // group_pieces)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        _encoder.cache_clear()  # the worker may have tokenised before
        g = g.sort_values(["row", "start"], ignore_index=True)
        window = pack_group(g["length"].tolist(), capacity)
        g["sequence_id"] = -1 - (g["bucket"].to_numpy() * (1 << 24) + window)
        g["offset"] = g.groupby("sequence_id")["length"].cumsum() - g["length"]
        return g.drop(columns=["row", "bucket"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    # A document's pieces go to different groups, so no group depends on a document's length.
    dealt = rest.withColumn("bucket", F.pmod(F.xxhash64("row", "start"), F.lit(groups)))
    return full.union(dealt.groupBy("bucket").applyInPandas(run, schema))


def op5_pack_sequences(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))
