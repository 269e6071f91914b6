"""Epsilon grid order join of embeddings by cosine similarity.

Vectors are scaled to unit length, where cosine >= t means Euclidean distance
<= sqrt(2 - 2t) = eps.  They are rotated onto principal axes, given the grid cell
of width eps on the leading axes, and sorted by cell (the epsilon grid order); a
finer grid orders the vectors of one cell.  The sorted sequence is cut into
intervals of ``block_rows`` vectors, and intervals into a tree of ``FAN`` children a
node.  Pairs of nodes are joined recursively from the root, as DataFrame joins
on the parent's id, under two bounds:

* boxes on the leading axes, or balls around both, lie further apart than eps: no vector
  of one links to any of the other, the pair is dropped;
* balls around both lie so close that every vector of one is within eps of every
  vector of the other: the pair is settled whole, by adding sizes, without
  looking at vectors.  A group of near copies costs its nodes, not its pairs.

What remains are pairs of intervals, compared in double precision.  Links leave
the comparison as counts per vector and as a spanning forest per pair, never as
all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import any_of, saved
from .components import components

#: Children of a node of the interval tree, as a power of two.
FAN_BITS = 4
#: Leading axes that carry the grid.
AXES = 8
_SLACK = 1e-9
#: Bytes of an interval's vectors as stored: long vectors make intervals of fewer rows, so a tile's memory is bounded.
BLOCK_BYTES = 1 << 18
_PART_BITS = 32


def least_linked(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n places, the least place connected to it through the pairs (i, j)."""
    low = np.arange(n)
    while len(i):
        before = low.copy()
        least = np.minimum(low[i], low[j])
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        low = low[low]
        if np.array_equal(before, low):
            break
    return low


def _usable(v: Column) -> Column:
    """True for vectors that can link: not null or empty, finite, not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def principal_axes(rows: DataFrame, sample: int, kind: str) -> dict[int, np.ndarray]:
    """For each vector length, an orthonormal rotation by falling variance.

    Fitted on at most about ``sample`` rows, chosen by a hash of their row number;
    any rotation gives the same links, a good one skips more.
    """
    n = rows.count()
    keep = int(1e6 * min(1.0, sample / max(n, 1)))
    got = rows.where(F.pmod(F.xxhash64("row"), F.lit(1_000_000)) < keep).select("vec").collect()
    out: dict[int, list] = {}
    for (raw,) in got:
        v = np.frombuffer(raw, dtype=kind).astype(np.float64)
        out.setdefault(len(v), []).append(v / np.linalg.norm(v))
    return {d: np.linalg.eigh(np.cov(np.array(vs).T.reshape(d, -1), bias=True).reshape(d, d))[1][:, ::-1] for d, vs in out.items()}


def _keys(axes: dict[int, np.ndarray], eps: float, kind: str):
    """Adds each vector's place in the epsilon grid order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = []
            for raw in b["vec"]:
                v = np.frombuffer(raw, dtype=kind).astype(np.float64)
                p = (v / np.linalg.norm(v)) @ axes.get(len(v), np.eye(len(v)))[:, :AXES]
                coarse = np.clip(np.floor(p / eps) + 128, 0, 255).astype(np.uint8)
                fine = np.clip(np.floor(p * 4 / eps) + 128, 0, 255).astype(np.uint8)
                keys.append(len(v).to_bytes(4, "big") + coarse.tobytes() + fine.tobytes())
            yield b.assign(key=keys)

    return run


_BLOCK = "block long, level int, dim int, n long, rep long, lo array<double>, hi array<double>, mid array<double>, radius double"


def _blocks(axes: dict[int, np.ndarray], block_rows: int, kind: str):
    """Cuts a sorted partition into intervals: one row each, with its vectors and bounds."""

    def head(rows: np.ndarray, raw: list[bytes], block: int) -> dict:
        vecs = np.array([np.frombuffer(r, dtype=kind).astype(np.float64) for r in raw])
        unit = vecs / np.linalg.norm(vecs, axis=1)[:, None]
        p = unit @ axes.get(unit.shape[1], np.eye(unit.shape[1]))
        mid = p.mean(axis=0)
        return {
            "block": block, "level": 0, "dim": p.shape[1], "n": len(rows), "rep": int(rows.min()),
            "lo": p[:, :AXES].min(axis=0), "hi": p[:, :AXES].max(axis=0), "mid": mid,
            "radius": float(np.sqrt(((p - mid) ** 2).sum(axis=1).max())),
            "rows": rows.astype(np.int64).tobytes(), "vecs": b"".join(raw),
        }

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, index = TaskContext.get().partitionId(), 0
        rows: list[int] = []
        raw: list[bytes] = []
        for b in batches:
            for r, v in zip(b["row"].tolist(), b["vec"]):
                if raw and (len(raw) >= max(1, min(block_rows, BLOCK_BYTES // len(v))) or len(raw[-1]) != len(v)):
                    yield pd.DataFrame([head(np.array(rows), raw, part << _PART_BITS | index)])
                    rows, raw, index = [], [], index + 1
                rows.append(r)
                raw.append(bytes(v))
        if raw:
            yield pd.DataFrame([head(np.array(rows), raw, part << _PART_BITS | index)])

    return run


def _merge_nodes(level: int):
    """Bounds of a node from those of its at most FAN children of one dimension."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        mids = np.array(g["mid"].tolist())
        mid = np.average(mids, axis=0, weights=g["n"])
        return pd.DataFrame([{
            "block": int(g["parent"].iloc[0]), "level": level, "dim": int(g["dim"].iloc[0]), "n": int(g["n"].sum()), "rep": int(g["rep"].min()),
            "lo": np.array(g["lo"].tolist()).min(axis=0), "hi": np.array(g["hi"].tolist()).max(axis=0), "mid": mid,
            "radius": float((np.sqrt(((mids - mid) ** 2).sum(axis=1)) + g["radius"].to_numpy()).max()),
        }])

    return run


def _gap(a: str, b: str) -> Column:
    """Squared distance of two boxes on the leading axes."""
    apart = F.zip_with(
        F.zip_with(f"{a}_lo", f"{b}_hi", lambda x, y: F.greatest(x - y, F.lit(0.0))),
        F.zip_with(f"{b}_lo", f"{a}_hi", lambda x, y: F.greatest(x - y, F.lit(0.0))),
        lambda x, y: F.greatest(x, y),
    )
    return F.aggregate(apart, F.lit(0.0), lambda s, x: s + x * x)


def _reach(a: str, b: str) -> Column:
    """An upper bound of the distance between a vector of one ball and one of the other."""
    square = F.aggregate(
        F.zip_with(f"{a}_mid", f"{b}_mid", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x
    )
    return F.sqrt(square) + F.col(f"{a}_radius") + F.col(f"{b}_radius")


def _ball_gap(a: str, b: str) -> Column:
    """A lower bound of the distance between a vector of one ball and one of the other."""
    square = F.aggregate(
        F.zip_with(f"{a}_mid", f"{b}_mid", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x
    )
    return F.sqrt(square) - F.col(f"{a}_radius") - F.col(f"{b}_radius")


def _side(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.select(*(F.col(c).alias(f"{name}_{c}") for c in nodes.columns))


def _compare(threshold: float, kind: str):
    """Streams tiles, the blocks of two tree nodes each: counts, and a spanning forest of each pair of blocks."""

    def pair(rows_a, a, rows_b, b, itself: bool):
        norm_a, norm_b = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
        near = (a @ b.T) / np.multiply.outer(norm_a, norm_b) >= threshold
        if itself:
            np.fill_diagonal(near, False)
        i, j = np.nonzero(near)
        if not len(i):
            return
        both = rows_a if itself else np.r_[rows_a, rows_b]
        low = least_linked(i, j if itself else j + len(rows_a), len(both))
        n = near.sum(axis=1) if itself else np.r_[near.sum(axis=1), near.sum(axis=0)]
        at = np.flatnonzero(n)
        yield pd.DataFrame({"row": both[at], "n": n[at], "to": both[low[at]]})

    def tile(blocks: dict, partners: dict) -> Iterator[pd.DataFrame]:
        for a, others in partners.items():
            for b in others:
                yield from pair(*blocks[a], *blocks[b], a == b)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, blocks, partners = None, {}, {}
        for batch in batches:
            for ta, tb, block, others, rows, vecs in zip(*(batch[c] for c in ("ta", "tb", "block", "partners", "rows", "vecs"))):
                if at != (ta, tb):
                    yield from tile(blocks, partners)
                    at, blocks, partners = (ta, tb), {}, {}
                ids = np.frombuffer(rows, dtype=np.int64)
                blocks[block] = ids, np.frombuffer(vecs, dtype=kind).reshape(len(ids), -1).astype(np.float64)
                if len(others):
                    partners[block] = list(others)
        yield from tile(blocks, partners)

    return run


def similarity_join(
    vectors: DataFrame,
    threshold: float = 0.9,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    block_rows: int = 512,
    fit_rows: int = 4096,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors``.

    ``n_links`` counts the other rows with cosine >= ``threshold``;
    ``component_id`` is the smallest id reachable by links, its own included;
    ``kept`` is true where both ids are equal.  Null, empty and zero vectors and
    those with null or non-finite components link with nothing, nor do vectors
    of different lengths.  Repeated rows are vectors of their own.  A row
    without an id keeps its links; ``kept`` is false then.  An empty table gives
    no rows.  ``fit_rows`` bounds the sample that the axes are fitted on; all
    rows are joined.
    """
    spark = vectors.sparkSession
    eps = float(np.sqrt(2 - 2 * threshold)) + _SLACK
    #: Vectors travel as they are stored; all arithmetic is in double precision.
    kind = "<f4" if dict(vectors.dtypes)[vec_col] == "array<float>" else "<f8"
    numbered = saved(
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
        .withColumn("row", F.monotonically_increasing_id())
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"row": b["row"], "vec": [scaled(np.asarray(v, dtype=np.float64)).astype(kind).tobytes() for v in b["v"]]})

    def scaled(v: np.ndarray) -> np.ndarray:
        """By a power of two, which is exact, so that squares of huge and tiny components are finite and not zero."""
        return np.ldexp(v, -int(np.frexp(np.abs(v).max())[1]))

    packed = numbered.where(_usable(F.col("v"))).select("row", "v").mapInPandas(pack, "row long, vec binary")
    axes = principal_axes(packed, fit_rows, kind)
    ordered = (
        packed.mapInPandas(_keys(axes, eps, kind), "row long, vec binary, key binary")
        .repartitionByRange("key", "row")
        .sortWithinPartitions("key", "row")
        .drop("key")
    )
    blocks = saved(ordered.mapInPandas(_blocks(axes, block_rows, kind), f"{_BLOCK}, rows binary, vecs binary"))

    # The tree. Ids of parents follow from those of children, so no ranking is needed.
    tops = blocks.agg(
        F.max(F.shiftright("block", _PART_BITS)), F.max(F.col("block").bitwiseAND((1 << _PART_BITS) - 1))
    ).first()
    if tops[0] is None:
        return numbered.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
            F.col("vec_id").isNotNull().alias("kept"),
        )
    inner = -(-max(1, int(tops[1]).bit_length()) // FAN_BITS)  # levels inside a partition
    outer = -(-max(1, int(tops[0]).bit_length()) // FAN_BITS)  # levels over partitions

    def parent(child: Column, level: int) -> Column:
        """Id at ``level`` of the node that holds a node of the level below."""
        if level <= inner:
            part = F.shiftleft(F.shiftright(child, _PART_BITS), _PART_BITS)
            return part + F.shiftright(child.bitwiseAND((1 << _PART_BITS) - 1), FAN_BITS)
        if level == inner + 1:
            child = F.shiftright(child, _PART_BITS)
        return F.shiftright(child, FAN_BITS)

    tree = [blocks.drop("rows", "vecs")]
    for level in range(1, inner + outer + 1):
        with_parent = tree[-1].withColumn("parent", parent(F.col("block"), level))
        tree.append(saved(with_parent.groupBy("dim", "parent").applyInPandas(_merge_nodes(level), _BLOCK)))

    # The recursion, from the root down. Pairs of nodes keep a <= b.
    pairs = tree[-1].select(F.col("block").alias("a"), F.col("block").alias("b"), "dim")
    whole = []
    for level in range(inner + outer, -1, -1):
        if level < inner + outer:
            below = tree[level].withColumn("parent", parent(F.col("block"), level + 1))
            left, right = _side(below, "l"), _side(below, "r")
            near = (
                pairs.join(left, (F.col("a") == F.col("l_parent")) & (F.col("dim") == F.col("l_dim")))
                .join(right, (F.col("b") == F.col("r_parent")) & (F.col("dim") == F.col("r_dim")))
                .where(F.col("l_block") <= F.col("r_block"))
            )
        else:
            left, right = _side(tree[level], "l"), _side(tree[level], "r")
            near = pairs.join(left, (F.col("a") == F.col("l_block")) & (F.col("dim") == F.col("l_dim"))).join(
                right, (F.col("b") == F.col("r_block")) & (F.col("dim") == F.col("r_dim"))
            )
        near = near.where((_gap("l", "r") <= eps * eps) & (_ball_gap("l", "r") <= eps + _SLACK)).select(
            F.col("l_block").alias("a"), F.col("r_block").alias("b"), "dim",
            (_reach("l", "r") <= eps - 2 * _SLACK).alias("whole"), "l_n", "r_n", "l_rep", "r_rep",
        )
        near = saved(near)
        settled = near.where("whole")
        same = F.col("a") == F.col("b")
        whole.append(
            settled.select(F.lit(level).alias("level"), "dim", F.col("a").alias("node"),
                           F.when(same, F.col("l_n") - 1).otherwise(F.col("r_n")).alias("n"), F.col("l_rep").alias("rep"), F.least("l_rep", "r_rep").alias("to"))
            .union(settled.where(~same).select(F.lit(level).alias("level"), "dim", F.col("b").alias("node"),
                           F.col("l_n").alias("n"), F.col("r_rep").alias("rep"), F.least("l_rep", "r_rep").alias("to")))
        )
        pairs = near.where(~F.col("whole")).select("a", "b", "dim")

    # Pairs of intervals, by tiles: the pairs below the same two parents, at most FAN ** 2.
    # An interval's vectors travel once to each tile, not once to each pair.
    tiles = pairs.select("a", "b", parent(F.col("a"), 1).alias("ta"), parent(F.col("b"), 1).alias("tb"))
    no_partner = F.array().cast("array<bigint>")
    needed = (
        tiles.select("ta", "tb", F.col("a").alias("block"), F.array("b").alias("p"))
        .union(tiles.select("ta", "tb", F.col("b").alias("block"), no_partner.alias("p")))
        .groupBy("ta", "tb", "block").agg(F.flatten(F.collect_list("p")).alias("partners"))
    )
    compared = saved(
        needed.join(blocks.select("block", "rows", "vecs"), "block")
        .repartition("ta", "tb").sortWithinPartitions("ta", "tb", "block")
        .mapInPandas(_compare(threshold, kind), "row long, n long, to long")
    )

    # What was settled whole goes from nodes to their intervals, then to vectors.
    all_whole = whole[0]
    for more in whole[1:]:
        all_whole = all_whole.union(more)
    by_node = saved(all_whole.groupBy("level", "dim", "node").agg(F.sum("n").alias("n"), F.min("rep").alias("rep")))
    node_links = all_whole.where("rep != to").select(F.col("rep").alias("a"), F.col("to").alias("b"))
    up, at, steps = blocks.select("block", "dim", "rows"), F.col("block"), []
    for level in range(inner + outer + 1):
        at = parent(at, level) if level else at
        steps.append(F.struct(F.lit(level).alias("level"), at.alias("node")))
    explode_rows = "row long, n long, to long"

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw, n, rep in zip(b["rows"], b["n"], b["rep"]):
                rows = np.frombuffer(raw, dtype=np.int64)
                yield pd.DataFrame({"row": rows, "n": np.full(len(rows), n), "to": np.full(len(rows), rep)})

    settled_rows = (
        up.withColumn("step", F.explode(F.array(*steps)))
        .join(by_node, (F.col("step.level") == by_node["level"]) & (F.col("step.node") == by_node["node"]) & (up["dim"] == by_node["dim"]))
        .select("rows", "n", "rep").mapInPandas(unpack, explode_rows)
    )
    found = compared.union(settled_rows)
    counts = found.where("n > 0").groupBy("row").agg(F.sum("n").alias("n_links"))
    links = found.where("to is not null and to != row").select(F.col("row").alias("a"), F.col("to").alias("b"))
    parts = components(links.union(node_links))
    keyed = (
        numbered.select("row", "vec_id")
        .join(counts, "row", "left")
        .join(parts, F.col("row") == F.col("node"), "left")
        .select("row", "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "component")
    )
    keyed = saved(keyed)
    least = keyed.where("component is not null").groupBy("component").agg(F.min("vec_id").alias("low"))
    return (
        keyed.join(least, "component", "left")
        .select("vec_id", "n_links", F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("low")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )


def op2_grid_join(spark, sf_dir: str) -> DataFrame:
    """Every vector with its links, its group and whether it stays."""
    return similarity_join(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
