"""Hard negatives from a vector-approximation file.

Vectors become whole numbers, and each component a cell: the cells of a dimension
are equally filled on a bounded sample.  Rows lie in blocks, a block's
rows sorted by label, with the cells apart from the exact vectors (:func:`blocks`).  For an
anchor, a table gives each cell's least and greatest part of the score; a row's look-ups
there add up to bounds of its score.  Only rows whose bounds may enter a window are scored
exactly:

1. positives: the window is the best few rows of the anchor's label;
2. negatives: for each positive, rows of other labels scoring between a share of its score and its score.

Both passes read the blocks where they are.  Anchors go to all tasks in parts of
bounded size, one job a part; a task keeps the best few rows of each window over all its blocks,
and those of all tasks are ranked again.  All arithmetic is exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Cells of a dimension.
CELLS = 64
#: Rows and bytes of exact vectors in a block.
BLOCK_ROWS, BLOCK_BYTES = 2048, 1 << 20
#: Bytes of anchors that one job sends to all tasks, about.
PART_BYTES = 4 << 20
_NO_ID = np.iinfo(np.int64).max
_BLOCK = "dim int, kind string, rows binary, ids binary, labels binary, low binary, high binary, codes binary, vecs binary"
#: Products of whole numbers in double precision are exact below this.
_EXACT = float(1 << 53)


def whole_vectors(rows: DataFrame, id_col: str, label_col: str, vec_col: str, relabel) -> DataFrame:
    """``(id, label, v)`` of the rows that take part: v holds floor(256 * x) as doubles, all finite."""
    v = F.col(vec_col).cast("array<double>")
    named = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x * 256) == float("inf")))
    return named.where(F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad).withColumn("label", relabel(F.col("id"), F.col("label")))


def fit_cells(rows: DataFrame, sample: int) -> dict[int, np.ndarray]:
    """For each vector length, the inner borders of each dimension's cells: quantiles of at most about ``sample`` rows."""
    n = rows.count()
    keep = int(1e6 * min(1.0, sample / max(n, 1)))
    got = rows.where(F.pmod(F.xxhash64("id", "label", "v"), F.lit(1_000_000)) < keep).select("v").limit(4 * sample).collect()
    by_length = defaultdict(list)
    for (v,) in got:
        by_length[len(v)].append(v)
    borders = np.linspace(0, 1, CELLS + 1)[1:-1]
    return {d: np.floor(np.quantile(np.floor(256 * np.array(vs)), borders, axis=0, method="lower")).T for d, vs in by_length.items() if d and len(vs) >= CELLS}


def blocks(rows: DataFrame, cells: dict[int, np.ndarray]) -> DataFrame:
    """The vector-approximation file: cells and exact vectors of up to BLOCK_ROWS rows of one length each; saved."""

    def made(dim: int, part: list[tuple]) -> dict:
        part.sort(key=lambda r: (r[2], r[0]))
        vecs = np.array([r[3] for r in part], dtype=np.float64).reshape(len(part), dim)
        kind = "<i2" if not vecs.size or np.abs(vecs).max() < 1 << 15 else "<f8"
        codes = np.zeros(vecs.shape, dtype=np.uint8)
        for k, borders in enumerate(cells.get(dim, ())):
            codes[:, k] = np.searchsorted(borders, vecs[:, k], side="right")
        ends = [f(axis=0) if dim else np.zeros(0) for f in (vecs.min, vecs.max)]
        return {
            "dim": dim, "kind": kind, "rows": np.array([r[0] for r in part], dtype=np.int64).tobytes(), "ids": np.array([r[1] for r in part], dtype=np.int64).tobytes(),
            "labels": np.array([r[2] for r in part], dtype=np.int64).tobytes(), "low": ends[0].tobytes(), "high": ends[1].tobytes(),
            "codes": np.ascontiguousarray(codes.T).tobytes(), "vecs": vecs.astype(kind).tobytes(),
        }

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        at, held = TaskContext.get().partitionId() << 40, defaultdict(list)
        for b in batches:
            for id_, label, v in zip(b["id"].fillna(_NO_ID).astype("int64"), b["label"], b["v"]):
                v = np.floor(256 * np.asarray(v, dtype=np.float64))
                held[len(v)].append((at, id_, label, v))
                at += 1
                if len(held[len(v)]) >= min(BLOCK_ROWS, max(1, BLOCK_BYTES // (8 * len(v) + 1))) or len(held) > 64:
                    largest = max(held, key=lambda d: len(held[d]) * (d + 1))
                    yield pd.DataFrame([made(largest, held.pop(largest))])
        for dim, part in held.items():
            yield pd.DataFrame([made(dim, part)])

    # Ids stay whole: a column with nulls would reach pandas as doubles.
    return saved(rows.withColumn("id", F.coalesce("id", F.lit(_NO_ID))).mapInPandas(run, _BLOCK))


class _Block:
    """A block's arrays, and the score bounds of its rows for an anchor."""

    def __init__(self, r, cells: dict[int, np.ndarray]):
        self.rows, self.ids, self.labels = (np.frombuffer(r[c], dtype=np.int64) for c in ("rows", "ids", "labels"))
        n, dim = len(self.rows), r["dim"]
        self.vecs = np.frombuffer(r["vecs"], dtype=r["kind"]).reshape(n, dim)
        low, high = np.frombuffer(r["low"]), np.frombuffer(r["high"])
        borders = cells.get(dim, np.zeros((dim, 0)))
        # A cell reaches from its border to the next one less one; the outer ones to the block's own ends.
        self.least = np.maximum(np.c_[low, borders], low[:, None])
        self.most = np.minimum(np.c_[borders - 1, high], high[:, None])
        width = self.least.shape[1]
        self.places = np.frombuffer(r["codes"], dtype=np.uint8).reshape(dim, n) + np.arange(dim)[:, None] * width
        self.largest = float(np.abs(np.r_[low, high]).max()) if dim else 0.0

    def exact(self, anchor: np.ndarray) -> bool:
        """Whether sums of products with this anchor are exact in double precision."""
        return len(anchor) * self.largest * float(np.abs(anchor).max() if len(anchor) else 0) < _EXACT

    def upper(self, anchor: np.ndarray, at) -> np.ndarray:
        a = anchor[:, None]
        return np.take(np.maximum(a * self.least, a * self.most).ravel(), self.places[:, at]).sum(axis=0)

    def lower(self, anchor: np.ndarray, at) -> np.ndarray:
        a = anchor[:, None]
        return np.take(np.minimum(a * self.least, a * self.most).ravel(), self.places[:, at]).sum(axis=0)

    def scores(self, anchor: np.ndarray, at: np.ndarray) -> list[int]:
        """Exact scores of rows; as long integers of any size where double precision does not do."""
        if self.exact(anchor):
            return (self.vecs[at].astype(np.float64) @ anchor).astype(np.int64).tolist()
        a = [int(x) for x in anchor]
        return [sum(x * int(y) for x, y in zip(a, v)) for v in self.vecs[at].tolist()]

    def of_label(self, label: int) -> tuple[int, int]:
        return tuple(np.searchsorted(self.labels, [label, label + 1]).tolist())


def _kth(values: np.ndarray, k: int) -> float:
    """The kth largest value, or minus infinity."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


class _Best:
    """The k rows that come first: by falling score, then id, then row."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def kth(self) -> float:
        return -self.rows[-1][0] if len(self.rows) == self.k else -np.inf

    def add(self, block: _Block, at, scores) -> None:
        self.rows += [(-s, int(block.ids[i]), int(block.rows[i])) for i, s in zip(at, scores)]
        self.rows.sort()
        del self.rows[self.k :]


def _long(x: int) -> int:
    """A score as a long; beyond its range, the nearest one."""
    return max(-(1 << 63), min((1 << 63) - 1, int(x)))


def _positives(anchors, cells, k: int):
    """Each task's first k rows of each anchor's label."""

    def search(block: _Block, row: int, label: int, vec: np.ndarray, best: _Best) -> None:
        lo, hi = block.of_label(label)
        at = np.arange(lo, hi)[block.rows[lo:hi] != row]
        if len(at) and block.exact(vec):
            need = max(best.kth(), _kth(block.lower(vec, at), k))
            at = at[block.upper(vec, at) >= need]
        if len(at):
            best.add(block, at, block.scores(vec, at))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = defaultdict(lambda: _Best(k))
        for b in batches:
            for r in b.to_dict("records"):
                block = _Block(r, cells.value)
                for row, _, label, vec in anchors.value.get(r["dim"], ()):
                    search(block, row, label, vec, best[row])
        out = [(row, i, _long(-s), other) for row, own in best.items() for s, i, other in own.rows]
        yield pd.DataFrame(out, columns=["anchor", "positive_id", "positive_score", "positive"])

    return run


def _negatives(anchors, cells, k: int, share: tuple[int, int]):
    """Each task's first k rows of other labels in each positive's window."""

    def search(block: _Block, label: int, vec: np.ndarray, windows: list) -> None:
        lo, hi = block.of_label(label)
        at = np.r_[0:lo, hi : len(block.rows)]
        if not len(at):
            return
        if block.exact(vec):
            least = min(max(low, best.kth()) for low, _, best in windows)
            upper = block.upper(vec, at)
            at, upper = at[upper >= least], upper[upper >= least]
            lower = block.lower(vec, at)
            wanted = np.zeros(len(at), dtype=bool)
            for low, high, best in windows:
                inside = lower[(lower >= low) & (upper <= high)]
                wanted |= (upper >= max(low, best.kth(), _kth(inside, k))) & (lower <= high)
            at = at[wanted]
        if len(at):
            scores = block.scores(vec, at)
            for low, high, best in windows:
                fit = [j for j, s in enumerate(scores) if low <= s <= high]
                best.add(block, at[fit], [scores[j] for j in fit])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows = {}
        for own in anchors.value.values():
            for row, positives, _, _ in own:
                # From the least score that reaches the share of the positive's to the positive's.
                windows[row] = [(-(-share[0] * s // share[1]), s, _Best(k)) for _, s, _ in positives]
        for b in batches:
            for r in b.to_dict("records"):
                block = _Block(r, cells.value)
                for row, _, label, vec in anchors.value.get(r["dim"], ()):
                    if open_ := [w for w in windows[row] if w[0] <= w[1]]:
                        search(block, label, vec, open_)
        out = []
        for own in anchors.value.values():
            for row, positives, _, _ in own:
                for (i, s, n), (_, _, best) in zip(positives, windows[row]):
                    out += [(row, n, i, s, j, _long(-t), other) for t, j, other in best.rows]
        names = ["anchor", "positive", "positive_id", "positive_score", "negative_id", "negative_score", "negative"]
        yield pd.DataFrame(out, columns=names)

    return run


def anchor_rows(stored_blocks: DataFrame, every: int) -> DataFrame:
    """``(anchor, anchor_id, label, dim, vec)`` of the rows whose id is divisible by ``every``; saved."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.to_dict("records"):
                rows, ids, labels = (np.frombuffer(r[c], dtype=np.int64) for c in ("rows", "ids", "labels"))
                vecs = np.frombuffer(r["vecs"], dtype=r["kind"]).reshape(len(rows), r["dim"])
                at = np.flatnonzero((ids % every == 0) & (ids != _NO_ID))
                raw = [vecs[i].astype("<f8").tobytes() for i in at]
                yield pd.DataFrame({"anchor": rows[at], "anchor_id": ids[at], "label": labels[at], "dim": r["dim"], "vec": raw})

    return saved(stored_blocks.mapInPandas(run, "anchor long, anchor_id long, label long, dim int, vec binary"))


def mine(
    vectors: DataFrame, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), every: int = 100, fit_rows: int = 4096,
    id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", relabel=lambda id_, label: label,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Rows with a null label, a null vector or a component that is null or not finite (256 times as
    large, too) take no part.  Only vectors of one length are compared.  A repeated row is another
    row with the same id: it may be the positive of its twin, and each anchor row has results of its own.  A row
    without an id is no anchor, comes last among ties, and is returned with a null id.  ``relabel``
    makes a row's label from its id and label.  ``fit_rows`` bounds the sample that cells are fitted on; any cells
    give the same result.  Scores beyond 64 bits are returned as the nearest long.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, id_col, label_col, vec_col, relabel)
    fitted = fit_cells(rows, fit_rows)
    cells = spark.sparkContext.broadcast(fitted)
    file = blocks(rows, fitted)
    anchors = anchor_rows(file, every)
    size = anchors.agg(F.coalesce(F.sum(F.length("vec") + 64), F.lit(0))).first()[0]
    parts = max(1, -(-size // PART_BYTES))
    anchors = anchors.withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(parts)))

    def sent(got: list):
        """Anchors by vector length, to all tasks."""
        by_length = defaultdict(list)
        for r in got:
            by_length[r["dim"]].append((r["anchor"], r["positives"], r["label"], np.frombuffer(r["vec"])))
        return spark.sparkContext.broadcast(dict(by_length))

    first = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "positive")
    window = Window.partitionBy("anchor", "positive").orderBy(F.desc("negative_score"), "negative_id", "negative")
    out = []
    for part in range(parts):
        own = anchors.where(F.col("part") == part)
        shared = sent(own.withColumn("positives", F.lit(None)).collect())
        near = file.mapInPandas(_positives(shared, cells, positives), "anchor long, positive_id long, positive_score long, positive long")
        near = near.withColumn("r", F.row_number().over(first)).where(F.col("r") <= positives)
        with_positives = saved(near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("positive_id", "positive_score", "positive"))).alias("positives")).join(own, "anchor"))
        shared = sent(with_positives.collect())
        schema = "anchor long, positive long, positive_id long, positive_score long, negative_id long, negative_score long, negative long"
        far = file.mapInPandas(_negatives(shared, cells, negatives, share), schema)
        far = far.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= negatives)
        out.append(saved(far.join(own.select("anchor", "anchor_id"), "anchor")))
    whole = out[0]
    for more in out[1:]:
        whole = whole.union(more)
    named = lambda c: F.when(F.col(c) != _NO_ID, F.col(c)).alias(c)
    return whole.select("anchor_id", named("positive_id"), "rank", named("negative_id"), "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive; every seventh label is moved on by one."""
    relabel = lambda id_, label: F.when(id_ % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), relabel=relabel)


#: The contract in SQL: sums of products of small whole numbers are exact as doubles.
OP11_SQL = """
with rows as (
  select row_number() over () as row, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0
),
scores as (
  select a.row as anchor, a.vec_id as anchor_id, a.label = b.label as same, b.row as other, b.vec_id as other_id, list_inner_product(a.v, b.v)::bigint as score
  from rows a join rows b on a.row <> b.row and len(a.v) = len(b.v) where a.vec_id % 100 = 0
),
positives as (select * from scores where same qualify row_number() over (partition by anchor order by score desc, other_id, other) <= 5),
ranked as (
  select p.anchor_id, p.other_id as positive_id, n.other_id as negative_id, p.score as positive_score, n.score as negative_score,
    row_number() over (partition by p.anchor, p.other order by n.score desc, n.other_id, n.other)::int as rank
  from positives p join scores n on p.anchor = n.anchor and not n.same and 80 * p.score <= 100 * n.score and n.score <= p.score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ranked where rank <= 5
"""
