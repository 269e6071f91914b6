"""SimHash near-duplicate detection with a Gray-order hierarchical index.

Fingerprints are made next to the scan, so that 16 bytes a document are
shuffled and never its text.  Equal fingerprints are merged before the search.
The index has *upper nodes*: a mask and the bit pattern that all fingerprints
below it share under that mask.  A radius of ``r`` bits is searched by ``r + 1``
masks that split the free bits evenly: two fingerprints within ``r`` bits agree
on one part at least, so they meet below one node at least.  A node that holds
more than ``leaf_rows`` fingerprints is factored again, over the bits its mask
leaves free; after ``ceil(log)`` levels so few bits are free that a node is small
by necessity.  So no group is unbounded, no pair is lost and no candidate is
capped.

What a task gets is sorted by node, then by Gray rank, and is one tree: leaves of
``LEAF`` fingerprints, ``FAN`` children a node, each with the bits that all below it
share.  Pairs of tree nodes are followed from the root; a pair goes, with all
below it, if it has no upper node in common, if its shared bits differ in more than
``r`` places already, or if all below it is joined.

:func:`first_of_each_group`, which the pipeline uses, searches twice: for what the
contract links (2 bits), and by 256-bit fingerprints of five-word shingles for a
similarity of about 0.8.  There the number of masks and their bits follow from the number of
fingerprints (see :func:`wide_shape`): nodes get smaller as there are more, and there are as many masks as
keep the probability that two such texts meet.  Both searches see all documents, and
the components are those of both searches' links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, columns_of, fresh, saved
from .components import components

#: Seed of the shingle hash.
SEED = 42
#: Words of a shingle of the wide fingerprint.
WIDE_SIZE = 5
#: Differing bits of 256 up to which two documents count as similar; the median is 35 at a similarity of 0.8
#: and 39 at 0.75 to 0.8 (measured on the smaller check tables).
MAX_WIDE = 47
#: Share of the bits in which two texts of similarity 0.8 differ, and the share of such pairs that may meet below no upper node.
DIFFER, MISSED = 0.15, 0.04
#: Comparisons a row, if the patterns were spread evenly, that the wide index allows before its masks take another bit.
COMPARED = 1024
#: A crowded node of the wide index is factored by so many masks of so many bits (0.997 of its pairs at 0.8 meet again).
SUB_BANDS, SUB_BITS = 12, 6
#: Fingerprints of a leaf, children of a tree node, and pairs of nodes that are looked at together.
LEAF, FAN, _PAIRS = 16, 4, 2048
_MIXERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_SLICE = 1 << 16


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode().lower().split() if text else []


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, repeats included; of the whole text if it is shorter."""
    h = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([h(joined, SEED)] if words else [], dtype=np.uint64)
    cuts = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    starts = [0, *(cuts + 1).tolist()]
    ends = [*cuts.tolist(), len(joined)][size - 1 :]
    return np.fromiter((h(joined[s:e], SEED) for s, e in zip(starts, ends)), dtype=np.uint64, count=len(ends))


def fingerprint(text: str | None, size: int = 3) -> int:
    """64 bits, each the majority of that bit over all shingle hashes; 0 without words."""
    return majority(shingle_hashes(words_of(text), size))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _SLICE):
        part = hashes[at : at + _SLICE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def wide_fingerprint(text: str | None, size: int = WIDE_SIZE) -> bytes:
    """256 bits: the majorities over four remixed hashes of every ``size``-word shingle."""
    return _wide(shingle_hashes(words_of(text), size))


def _wide(hashes: np.ndarray) -> bytes:
    return b"".join(majority(_remixed(hashes, m)).to_bytes(8, "little") for m in _MIXERS)


def _remixed(hashes: np.ndarray, mixer: int) -> np.ndarray:
    x = hashes * np.uint64(mixer)
    x ^= x >> np.uint64(32)
    x *= np.uint64(_MIXERS[-1])
    return x ^ x >> np.uint64(29)


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``: the fingerprint of every row's whole text, as a signed long.

    Null and empty texts have fingerprint 0.  Repeated rows stay; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), size) for t in b.column("text")), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


WIDE = ("w0", "w1", "w2", "w3")


def both_fingerprints(text: Column, size: int = 3) -> Column:
    """``struct(fp, w0, w1, w2, w3)``: the fingerprint, and the 256-bit one in four longs."""

    @F.pandas_udf("struct<fp:long,w0:long,w1:long,w2:long,w3:long>")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = np.empty((len(texts), 5), dtype=np.uint64)
        for k, t in enumerate(texts):
            words = words_of(t)
            out[k, 0] = majority(shingle_hashes(words, size))
            out[k, 1:] = np.frombuffer(_wide(shingle_hashes(words, WIDE_SIZE)), dtype=np.uint64)
        return pd.DataFrame(out.view(np.int64), columns=["fp", *WIDE])

    return run(text)


# --- the index -------------------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def child_masks(mask: int, radius: int) -> list[int]:
    """``radius + 1`` masks, each ``mask`` and an even share of the bits it leaves free."""
    free = [b for b in range(64) if not mask >> b & 1]
    parts = np.array_split(np.array(free, dtype=np.int64), radius + 1)
    return [mask | sum(1 << int(b) for b in part) for part in parts]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n places, the least place it is linked to through the pairs (i, j)."""
    low = np.arange(n)
    while len(i):
        least = np.minimum(low[i], low[j])
        before = low.copy()
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        low = low[low]
        if np.array_equal(before, low):
            break
    return low


def joined_rows(group: np.ndarray, codes: np.ndarray, radius: int, stats: dict | None = None) -> np.ndarray:
    """For each row, the least row that links of at most ``radius`` bits join it to, inside its group.

    ``codes`` holds a row of 64-bit words a fingerprint; rows are sorted by group,
    then by Gray rank.  ``stats`` gets the numbers of node pairs pruned and of
    leaf pairs compared.
    """
    n, low = len(group), np.arange(len(group))
    if not n:
        return low
    levels, width = [], LEAF
    while True:  # the tree, from the leaves up
        at = np.arange(0, n, width)
        ones, some = np.bitwise_and.reduceat(codes, at), np.bitwise_or.reduceat(codes, at)
        levels.append((at, group[at], group[np.minimum(at + width, n) - 1], ones, ~(ones ^ some)))
        if len(at) == 1:
            break
        width *= FAN
    stack = [(len(levels) - 1, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    roots: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    while stack:
        level, i, j = stack.pop()
        if len(i) > _PAIRS:
            stack.append((level, i[_PAIRS:], j[_PAIRS:]))
            i, j = i[:_PAIRS], j[:_PAIRS]
        at, first, last, ones, same = levels[level]
        if level not in roots:
            roots[level] = np.minimum.reduceat(low, at), np.maximum.reduceat(low, at)
        least, most = roots[level]
        apart = np.bitwise_count((ones[i] ^ ones[j]) & same[i] & same[j]).sum(axis=1, dtype=np.int64) > radius
        keep = (last[i] >= first[j]) & ~apart & ~((least[i] == most[i]) & (least[j] == most[j]) & (least[i] == least[j]))
        if stats is not None:
            stats["pruned"] = stats.get("pruned", 0) + int((~keep).sum())
        i, j = i[keep], j[keep]
        if level:
            children = levels[level - 1][0].shape[0]
            steps = np.arange(FAN)
            i, j = (x.ravel() for x in np.broadcast_arrays((i[:, None] * FAN + steps)[:, :, None], (j[:, None] * FAN + steps)[:, None, :]))
            inside = (i <= j) & (j < children)
            i, j = i[inside], j[inside]
            # What lies close together comes first: it joins most, and joined nodes are not followed.
            for part in (i != j, i == j):
                if part.any():
                    stack.append((level - 1, i[part], j[part]))
            continue
        if stats is not None:
            stats["compared"] = stats.get("compared", 0) + len(i)
        place = np.arange(LEAF)
        a, b = i[:, None] * LEAF + place, j[:, None] * LEAF + place
        in_a, in_b = np.minimum(a, n - 1), np.minimum(b, n - 1)
        near = np.zeros((len(i), LEAF, LEAF), dtype=np.int64)
        for w in range(codes.shape[1]):
            near += np.bitwise_count(codes[in_a, w][:, :, None] ^ codes[in_b, w][:, None, :])
        hit = (near <= radius) & (group[in_a][:, :, None] == group[in_b][:, None, :]) & (a[:, :, None] < b[:, None, :]) & (b < n)[:, None, :]
        k, x, y = np.nonzero(hit)
        if len(k):
            low = _forest(np.r_[a[k, x], np.arange(n)], np.r_[b[k, y], low], n)
            roots.clear()
    return low


#: Rows that a task looks at together, unless one node has more.
_CHUNK = 1 << 16


def _leaf_links(radius: int, keys: tuple[str, ...], words: tuple[str, ...]):
    """Streams rows sorted by ``keys``: links between the ``fp`` of rows whose ``words`` are close."""

    def links(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        codes = np.stack([rows[w].view(np.uint64) for w in words], axis=1)
        group = np.zeros(len(codes), dtype=np.int64)
        for k in keys:
            group[1:] |= rows[k][1:] != rows[k][:-1]
        group = np.cumsum(group)
        order = np.lexsort((gray_rank(codes[:, 0]), group))
        fp = rows["fp"][order]
        low = joined_rows(group[order], codes[order], radius)
        moved = np.flatnonzero(fp != fp[low])
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[low[moved]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = tuple(dict.fromkeys((*keys, "fp", *words)))
        held: list[dict[str, np.ndarray]] = []
        count, limit = 0, _CHUNK
        for b in batches:
            if not b.num_rows:
                continue
            held.append({c: b.column(c).to_numpy(zero_copy_only=False) for c in names})
            count += b.num_rows
            if count < limit:
                continue
            rows = {c: np.concatenate([h[c] for h in held]) for c in names}
            last = np.ones(count, dtype=bool)
            for k in keys:
                last &= rows[k] == rows[k][-1]
            cut = int(last.argmax())  # the last node's rows are together, at the end
            if cut:
                yield links({c: v[:cut] for c, v in rows.items()})
            held, count = [{c: v[cut:].copy() for c, v in rows.items()}], count - cut
            limit = max(_CHUNK, 2 * count)
        if count:
            yield links({c: np.concatenate([h[c] for h in held]) for c in names})

    return run


def _children(radius: int):
    """Each row once below each of its node's children."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks: dict[int, list[int]] = {}
        for b in batches:
            mask, fp = b.column("mask").to_numpy(), b.column("fp").to_numpy()
            for m in np.unique(mask).tolist():
                if m not in masks:
                    masks[m] = [_signed(c) for c in child_masks(m & (1 << 64) - 1, radius)]
                own = fp[mask == m]
                for child in masks[m]:
                    columns = np.full(len(own), child, dtype=np.int64), own & np.int64(child), own
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["mask", "pattern", "fp"])

    return run


def similar(fps: DataFrame, radius: int = 2, leaf_rows: int = 4096) -> DataFrame:
    """``(a, b)``: links whose components are those of all pairs of ``fp`` within ``radius`` bits.

    ``fps`` holds distinct non-null ``fp``.  Every link joins two fingerprints that
    pairs within the radius connect.
    """
    first = F.explode(F.array(*(F.lit(_signed(m)) for m in child_masks(0, radius)))).alias("mask")
    nodes = fps.select("fp", first).select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("pattern"), "fp")
    out = []
    while True:
        sizes = nodes.groupBy("mask", "pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf_rows)
        crowded = saved(sizes.select("mask", "pattern"))
        more = not crowded.isEmpty()
        leaves = nodes.join(crowded, ["mask", "pattern"], "left_anti") if more else nodes
        out.append(
            leaves.select("mask", "pattern", "fp").repartition("mask", "pattern")
            .sortWithinPartitions("mask", "pattern").mapInArrow(_leaf_links(radius, ("mask", "pattern"), ("fp",)), "a long, b long")
        )
        if not more:
            break
        # Every level takes its share of the free bits, so a node ends below leaf_rows: 2 ** free bits bound it.
        inside = nodes.join(crowded, ["mask", "pattern"], "left_semi").select("mask", "pattern", "fp")
        nodes = saved(inside.mapInArrow(_children(radius), "mask long, pattern long, fp long"))
    links = out[0]
    for more_links in out[1:]:
        links = links.union(more_links)
    return links


def wide_shape(rows: int, compared: int = COMPARED) -> tuple[int, int]:
    """Bits a mask and number of masks of the wide index over so many fingerprints.

    The fewest bits with which a row meets ``compared`` others by chance at most, over all masks; and as many
    masks as let a pair at a similarity of 0.8 miss all with a probability of ``MISSED``, whatever the bits.
    """
    bits, masks = 0, 1
    while masks * rows > compared << bits:
        bits += 1
        masks = math.ceil(math.log(MISSED) / math.log1p(-((1 - DIFFER) ** bits)))
    return bits, masks


def wide_masks(bits: int, masks: int, level: int = 0) -> list[np.ndarray]:
    """The places of each mask's bits, drawn without repeats until all 256 are used up."""
    rng = np.random.default_rng([level, bits])
    each, out = max(1, 256 // max(1, bits)), []
    while len(out) < masks:
        order = rng.permutation(256)
        out += [np.sort(order[k * bits : (k + 1) * bits]) for k in range(each)]
    return out[:masks]


def _wide_nodes(masks: list[np.ndarray], sizes_only: bool):
    """Each row below one node a mask: ``(node, above, fp, words)``; or a row each with all its nodes, ``(nodes, above)``.

    A node's key is a hash of the node above it, the mask and the pattern; two nodes with one key are compared as one.
    """
    weights = [np.uint64(1) << np.arange(len(m), dtype=np.uint64) for m in masks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = lambda c: b.column(c).to_numpy(zero_copy_only=False)
            codes = np.stack([column(w) for w in WIDE], axis=1)
            bits = np.unpackbits(codes.view(np.uint8).reshape(len(codes), 32), axis=1, bitorder="little")
            over, keys = column("node").view(np.uint64), []
            for k, (mask, weight) in enumerate(zip(masks, weights)):
                pattern = bits[:, mask].astype(np.uint64) @ weight + np.uint64(k + 1) * np.uint64(1 << 48)
                key = _remixed(_remixed(over, _MIXERS[0]) ^ pattern, _MIXERS[1]).view(np.int64)
                if sizes_only:
                    keys.append(key)
                else:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), *(b.column(c) for c in ("above", "fp", *WIDE))], names=["node", "above", "fp", *WIDE]
                    )
            if sizes_only:
                ends = pa.array(np.arange(len(codes) + 1) * len(masks), pa.int32())
                nodes = pa.ListArray.from_arrays(ends, pa.array(np.stack(keys, axis=1).ravel()))
                yield pa.RecordBatch.from_arrays([nodes, b.column("above")], names=["nodes", "above"])

    return run


def similar_wide(fps: DataFrame, max_wide: int = MAX_WIDE, leaf_rows: int = 4096, compared: int = COMPARED) -> DataFrame:
    """``(a, b)``: links between the ``fp`` of rows whose 256 bits differ in ``max_wide`` places at most.

    ``fps`` holds distinct ``(fp, w0, w1, w2, w3)``.  Rows meet below the upper nodes of
    :func:`wide_shape`, all of them if there are at most ``compared``.  A node of more than ``leaf_rows`` is factored
    again and again, while every level leaves a quarter of the node above at most.  Nodes that further bits don't divide
    hold near copies: they are cut into blocks, and every pair of blocks is compared in a group of its own.
    """
    rows = fps.count()
    bits, masks = wide_shape(rows, compared)
    at, level = fps.select(F.lit(0).cast("long").alias("node"), F.lit(rows).cast("long").alias("above"), "fp", *WIDE), 0
    columns = ["node", "above", "fp", *WIDE]

    def links(nodes: DataFrame) -> DataFrame:
        ordered = nodes.select("node", "fp", *WIDE).repartition("node").sortWithinPartitions("node")
        return ordered.mapInArrow(_leaf_links(max_wide, ("node",), WIDE), "a long, b long")

    found = None
    while True:
        places = wide_masks(bits, masks, level)
        nodes = at.mapInArrow(_wide_nodes(places, False), ", ".join(f"{c} long" for c in columns))
        each = at.mapInArrow(_wide_nodes(places, True), "nodes array<long>, above long").select(F.explode("nodes").alias("node"), "above")
        sizes = each.groupBy("node").agg(F.max("above").alias("above"), F.count(F.lit(1)).alias("n"))
        tight = (F.lit(level > 0) & (4 * F.col("n") > F.col("above"))).alias("tight")
        crowded = saved(sizes.where(F.col("n") > leaf_rows).select("node", "n", tight))
        if crowded.isEmpty():
            new = links(nodes)
            return new if found is None else found.union(new)
        few = bounded(crowded)
        blocks = F.ceil(F.col("n") / (4 * leaf_rows))
        own = F.pmod(F.xxhash64("fp", *WIDE), blocks)
        pairs = nodes.join(few.where("tight"), "node").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        pairs = pairs.withColumn("node", F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")))
        new = links(nodes.join(few.select("node"), "node", "left_anti").select(columns).union(pairs.select(columns)))
        found = new if found is None else found.union(new)
        at = saved(nodes.join(few.where("not tight"), "node").select("node", F.col("n").alias("above"), "fp", *WIDE))
        bits, masks, level = SUB_BITS, SUB_BANDS, level + 1


def _grouped(fps: DataFrame, radius: int, leaf_rows: int) -> DataFrame:
    """``(fp, part)``: a key of the component of each distinct fingerprint of a saved table."""
    reps = saved(fps.select("fp").distinct())
    parts = components(similar(reps, radius, leaf_rows))
    return reps.join(parts, reps["fp"] == parts["node"], "left").select("fp", F.coalesce("component", "fp").alias("part"))


def near_duplicates(
    docs: DataFrame, radius: int = 2, size: int = 3, leaf_rows: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row.

    ``component_id`` is the smallest ``doc_id`` reachable by links of at most
    ``radius`` differing bits, itself included; null only if no row of the
    component has an id.  Null and empty texts share fingerprint 0 and link like
    any other.  Rows repeat as they come; an empty table gives no rows; other
    columns of ``docs`` are not read.
    """
    fps = saved(fingerprints(docs, size, id_col, text_col))
    keyed = saved(_grouped(fps, radius, leaf_rows))
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).join(keyed, "fp")
    least = reps.groupBy("part").agg(F.min("rep").alias("component_id"))
    named = keyed.join(least, "part").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def _all_but_first(placed: DataFrame, row_col: str) -> DataFrame:
    """Of each ``part``, every row but the one with the smallest id; ties and null ids by row number, null ids last."""
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id"), F.col(row_col).alias("row"))
    kept = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).where("n > 1")
    # As a table of its own, so that the join can split the rows of a large group.
    kept = bounded(saved(kept.select("part", "first")))
    return placed.join(kept, "part").where(F.col(row_col) != F.col("first.row")).select(row_col)


def _redundant(fps: DataFrame, row_col: str, radius: int, max_wide: int, leaf_rows: int) -> DataFrame:
    """One column ``row_col`` of a saved table ``(row_col, _id, fp, w0, w1, w2, w3)``: every row but one of each group."""
    each = saved(fps.select("fp", *WIDE).distinct())
    reps = saved(each.select("fp").distinct())
    parts = components(similar(reps, radius, leaf_rows).union(similar_wide(each, max_wide, leaf_rows)))
    # A table of its own, so that the join can split the rows of a frequent fingerprint.
    grouped = bounded(saved(reps.join(parts, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("part"))))
    return _all_but_first(saved(fps.select(row_col, "fp", "_id").join(grouped, "fp").select(row_col, "part", "_id")), row_col)


def redundant_rows(
    docs: DataFrame, row_col: str, radius: int = 2, size: int = 3, max_wide: int = MAX_WIDE, leaf_rows: int = 4096,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One column ``row_col``: every row but one of each near-duplicate group.

    ``row_col`` holds distinct numbers that do not change from scan to scan.  The row with the
    smallest id stays, ties and null ids by row number; null ids come last.
    Groups are joined by links of ``radius`` bits, and by links of 256-bit fingerprints
    that differ in ``max_wide`` bits at most, among all rows alike: a row
    that goes still links others.  Null and empty texts form one group.  An empty table gives no rows.
    """
    fps = saved(docs.select(F.col(row_col), F.col(id_col).alias("_id"), both_fingerprints(F.col(text_col), size).alias("_f")).select(row_col, "_id", "_f.*"))
    return _redundant(fps, row_col, radius, max_wide, leaf_rows)


def first_of_each_group(
    docs: DataFrame, radius: int = 2, size: int = 3, max_wide: int = MAX_WIDE, leaf_rows: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` but the :func:`redundant_rows`; columns stay as they are.

    Rows are numbered once, in a stored copy that holds their fingerprints too, so the
    numbers are the same for every later job.
    """
    row, found = fresh(docs, "_row"), fresh(docs, "_found")
    rows = saved(docs.withColumns({row: F.monotonically_increasing_id(), found: both_fingerprints(F.col(text_col), size)}))
    fps = rows.select(F.col(row).alias("_row"), F.col(id_col).alias("_id"), *(F.col(f"{found}.{c}").alias(c) for c in ("fp", *WIDE)))
    dropped = saved(_redundant(fps, "_row", radius, max_wide, leaf_rows).select(F.col("_row").alias(row)))
    return rows.join(bounded(dropped), row, "left_anti").select(*columns_of(docs))


def op9_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the id of its near-duplicate group."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
