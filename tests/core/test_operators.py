"""Operators on small literals, published figures, and plain loops."""

import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rollstats.functions import scalars
from rollstats.operators import charts, grouping, imaging, labeling, rolls, stats

# Published rolls of one d20 and histograms of two d6.
D20 = [108, 130, 141, 150, 97, 106, 92, 127, 140, 140, 155, 127, 108, 114, 104, 88, 130, 113, 120, 107]
RED = [(1, 0.16633, 0.15274, 0.18043), (2, 0.16884, 0.15528, 0.18141), (3, 0.15477, 0.14121, 0.16884), (4, 0.17487, 0.16131, 0.18794), (5, 0.15879, 0.14520, 0.17186), (6, 0.17638, 0.16332, 0.19048)]
YELLOW = [(1, 0.16150, 0.14797, 0.17600), (2, 0.17200, 0.15900, 0.18650), (3, 0.16450, 0.15047, 0.17850), (4, 0.17350, 0.16000, 0.18800), (5, 0.16150, 0.14800, 0.17600), (6, 0.16700, 0.15350, 0.18050)]
SUMS = {2: (0.02686, 0.02260, 0.03176), 7: (0.16646, 0.14055, 0.19536), 12: (0.02946, 0.02507, 0.03438)}
FIRST_100 = [1, 18, 14, 17, 11, 4, 12, 14, 6, 19, 6, 2, 2, 4, 11, 17, 7, 19, 14, 14, 15, 19, 7, 13, 14, 2, 18, 2, 19, 14, 3, 19, 14, 12, 13, 17, 17, 20, 4, 17, 15, 14, 7, 3, 14, 15, 8, 12, 6, 8, 6, 13, 19, 18, 9, 19, 5, 19, 1, 2, 14, 4, 20, 6, 4, 18, 9, 1, 12, 1, 7, 8, 8, 7, 10, 6, 17, 18, 2, 9, 10, 6, 15, 14, 1, 14, 3, 2, 4, 16, 17, 9, 15, 3, 12, 2, 2, 16, 7, 10]
HIST = "side int, p double, ci_low double, ci_high double"


def dice(spark, **sides):
    rows = [(d, k + 1, s) for d, all_ in sides.items() for k, s in enumerate(all_)]
    return spark.createDataFrame(rows, "die_id string, seq long, side int").repartition(3)


@pytest.fixture(scope="module")
def d20(spark):
    return dice(spark, d=[s for s, n in enumerate(D20, 1) for _ in range(n)]).cache()


def test_chi_square_of_a_published_die(d20):
    r = stats.chi_square(d20).first()
    assert abs(r.statistic - 58.36086775) < 1e-6 and r.dof == 19 and abs(r.p - 7.0096e-06) < 1e-9


@pytest.mark.parametrize("dof", [1, 2, 3, 4, 7, 10, 19, 50])
def test_survival_against_numerical_integration(spark, dof):
    xs = [0.5, 1.0, 5.0, 20.0, 60.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(scalars.chi2_survival(F.col("x"), F.lit(dof))).collect()]
    for x, p in zip(xs, got):
        t = np.linspace(math.sqrt(x), 40, 400_001)  # t^2 is the variable: no pole at 0
        y = 2 * t ** (dof - 1) * np.exp(-t * t / 2) / (2 ** (dof / 2) * math.gamma(dof / 2))
        assert abs(np.trapezoid(y, t) - p) < 1e-7


def test_summary_of_a_published_die(d20):
    r = stats.summary_stats(d20).first()
    assert (r.n, r.k, r.fair) == (2397, 20, 0.05) and round(r.expected, 2) == 10.30
    assert round(r.stddev, 3) == 0.008 and round(r.min_p, 3) == 0.037 and round(r.max_p, 3) == 0.065


def test_sum_of_two_published_dice(spark):
    a, b = (spark.createDataFrame(x, HIST) for x in (RED, YELLOW))
    got = {r.side: (r.p, r.ci_low, r.ci_high) for r in stats.combine(a, b).collect()}
    assert sorted(got) == list(range(2, 13)) and abs(sum(p for p, _, _ in got.values()) - 1) < 1e-4
    for side, want in SUMS.items():
        assert all(abs(x - y) < 6e-6 for x, y in zip(got[side], want))


def test_first_rolls_of_a_published_die(spark):
    counts = rolls.label_counts(dice(spark, d=FIRST_100))
    freq = {r.side: r.freq for r in rolls.normalized(counts).collect()}
    assert [round(freq[s], 9) for s in range(1, 7)] == [1.0, 1.8, 0.8, 1.2, 0.2, 1.4]


def test_bootstrap_lies_near_the_analytic_interval(d20):
    n = sum(D20)
    for r in stats.bootstrap(d20).collect():
        width = 1.6449 * math.sqrt(r.p * (1 - r.p) / n)
        assert r.p == D20[r.side - 1] / n and r.ci_low <= r.p <= r.ci_high
        assert abs(r.ci_low - (r.p - width)) < 0.09 / math.sqrt(n) and abs(r.ci_high - (r.p + width)) < 0.09 / math.sqrt(n)


def test_dense_counts_keep_gaps(spark):
    got = {(r.die_id, r.side): r.n for r in rolls.dense_counts(dice(spark, a=[1, 1, 3], b=[7]), 4).collect()}
    assert [got["a", s] for s in range(5)] == [0, 2, 0, 1, 0] and got["b", 7] == 1 and ("a", 5) not in got


@pytest.mark.parametrize("chunk", [1, 3, 1 << 20])
def test_transitions_over_chunks(spark, chunk):
    rng = random.Random(chunk)
    seqs = {"a": [rng.randint(1, 4) for _ in range(50)], "b": [2], "c": [1, 1]}
    want = {}
    for d, s in seqs.items():
        for x, y in zip(s, s[1:]):
            want[d, x, y] = want.get((d, x, y), 0) + 1
    df = dice(spark, **seqs)
    assert {(r.die_id, r.from_side, r.to_side): r.n for r in rolls.transitions(df, chunk).collect()} == want
    dense = rolls.dense_transitions(df).collect()
    assert sum(r.n for r in dense) == sum(len(s) - 1 for s in seqs.values()) and sum(r.die_id == "b" for r in dense) == 4


def test_prefixes_and_subsamples(spark):
    df = dice(spark, a=[1, 2, 3, 1, 2], b=[4])
    got = {(r.die_id, r.size, r.side): r.n for r in rolls.prefix_histogram(df, [2, 4]).collect()}
    assert got == {("a", 2, 1): 1, ("a", 2, 2): 1, ("a", 4, 1): 2, ("a", 4, 2): 1, ("a", 4, 3): 1, ("b", 2, 4): 1, ("b", 4, 4): 1}
    sub = stats.subsample_histogram(df, [3, 5]).collect()
    assert {r.die_id for r in sub} == {"a"} and {(r.side, r.freq) for r in sub if r.size == 5} == {(1, 1.2), (2, 1.2), (3, 0.6)}


def test_first_ranked_of_a_hot_key(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("die_id"), (F.col("id") * 7919 % 20_011).alias("seq"))
    want = df.toPandas().sort_values("seq").groupby("die_id").head(1500)
    got = rolls.first_ranked(df, ["die_id"], ["seq"], 1500, "seq").toPandas()
    assert sorted(zip(want["die_id"], want["seq"])) == sorted(zip(got["die_id"], got["seq"]))
    assert all(sorted(g["rank"]) == list(range(1, len(g) + 1)) and g.sort_values("rank")["seq"].is_monotonic_increasing for _, g in got.groupby("die_id"))


def test_label_sequence_over_many_ranges(spark):
    rows = [(d, f"{k * 37 % 1000:04}.jpg", label) for d, n in (("a", 900), ("b", 30), (None, 5)) for k in range(n) for label in ([6, 1] if k % 50 == 0 else [k % 6])]
    df = spark.createDataFrame(rows + rows[:40], "die_id string, file string, label int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(tuple, labeling.label_sequence(df, "die_id").collect()), key=str)
        whole = [r.label for r in labeling.label_sequence(df).orderBy("seq").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    each = lambda d: sorted({r[1:] for r in rows if r[0] == d})
    assert got == sorted(((d, k + 1, label) for d in ("a", "b", None) for k, (_, label) in enumerate(each(d))), key=str)
    assert whole == [label for _, label in sorted({r[1:] for r in rows})]
    assert labeling.label_sequence(df.limit(0), "die_id").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 59), st.integers(0, 59), st.integers(1, 59))
def test_squaring_is_stepwise_widening(low, high, length):
    low, high = min(low, high), max(low, high)
    a, b, limit = low, high, 60
    while b - a < length:
        a, b = max(a - 1, 0), min(b + 1, limit - 1)
    missing = length - (high - low)
    steps = max(-(-missing // 2), missing - low, missing - (limit - 1 - high), 0)
    assert max(low - steps, 0) == a


def test_squares(spark):
    r = spark.range(1).select(*(scalars.squared(F.lit(a), F.lit(b), F.lit(100), F.lit(n)).alias(k) for k, (a, b, n) in {"mid": (40, 50, 20), "left": (2, 8, 30), "right": (95, 99, 30), "cut": (10, 60, 20), "none": (0, 5, 100)}.items())).first()
    assert tuple(r.mid) == (35, 55) and tuple(r.left) == (0, 30) and tuple(r.right) == (69, 99) and tuple(r.cut) == (10, 30) and r.none is None


def test_scalars(spark):
    r = spark.range(1).select(
        scalars.eccentricity(F.lit(4), F.lit(8)).alias("e"), scalars.eccentricity(F.lit(4), F.lit(0)).alias("flat"), scalars.eccentricity(F.lit(0), F.lit(4)).alias("thin"),
        scalars.feature_proportion(F.lit(3), F.lit(4)).alias("f"), scalars.feature_proportion(F.lit(0), F.lit(4)).alias("f0"),
        scalars.grey(F.lit(3), F.lit(4)).alias("g"), scalars.grey(F.lit(0), F.lit(0)).alias("g0"), scalars.percent(F.lit(0.059)).alias("pc"),
        scalars.verdict(F.lit(0.0505), F.lit(0.05)).alias("v"), scalars.histogram_line(F.lit(7), F.lit(0.06), F.lit(0.04), F.lit(0.07), F.lit(0.05)).alias("line"),
    ).first()
    assert (r.e, r.flat, r.thin) == (2.0, math.inf, math.inf) and abs(r.f - 4 / 3) < 1e-12 and r.f0 == math.inf
    assert (r.g, r.g0, r.pc, r.v) == (190, 0, 5, "within")
    assert r.line == " 7 0.060 " + " " * 40 + "[" + "=" * 9 + "*" + "=" * 9 + "o" + "=" * 9 + "]"


def test_labels(spark):
    groups = spark.createDataFrame([(0, "b"), (0, "a"), (1, "c"), (2, "a")], "group_idx int, file string")
    labels = lambda *x: spark.createDataFrame(list(enumerate(x)), "group_idx int, label int")
    got = labeling.assign_labels(groups, labels(4, 2, 6))
    assert [(r.seq, r.label) for r in labeling.label_sequence(got).orderBy("seq").collect()] == [(1, 4), (2, 6), (3, 4), (4, 2)]
    assert sorted(r.label for r in labeling.missing_labels(got).collect()) == [1, 3, 5]
    assert {(r.file, r.label) for r in labeling.assign_labels(groups, labels(4), repeat=9).collect()} == {("b", 4), ("a", 4), ("c", 9), ("a", 9)}
    for bad in ((labels(1, 2), None), (labels(1, 2, 3, 4), None), (labels(1, 2, 3), 1)):
        with pytest.raises(ValueError):
            labeling.assign_labels(groups, *bad)


def test_leaders_equal_the_sequential_loop(spark):
    for seed in range(4):
        rng = random.Random(seed)
        n = 60
        match = {(i, j) for i in range(n) for j in range(i) if rng.random() < 0.06}
        heads, want = [], {}
        for i in range(n):
            want[i] = next((h for h in heads if (i, h) in match), i)
            heads += [i] if want[i] == i else []
        items = spark.range(n).select(F.col("id").alias("item"))
        edges = spark.createDataFrame(sorted(match), "item long, other long")
        assert {r.item: r.leader for r in grouping.leaders(items, edges).collect()} == want
    assert {r.leader for r in grouping.leaders(items, edges.limit(0)).collect()} == set(range(n))


def test_small_groups(spark):
    rows = [("a", "r1", 40), ("a", "r2", 12), ("a", "r3", 9), ("a", "r4", 30), ("b", "x", 5), ("c", "p", 10), ("c", "q", 9)]
    got = {(r.die_id, r.rep): r.small for r in grouping.split_small(spark.createDataFrame(rows, "die_id string, rep string, size long")).collect()}
    assert got == {("a", "r1"): False, ("a", "r4"): False, ("a", "r2"): False, ("a", "r3"): True, ("b", "x"): False, ("c", "p"): False, ("c", "q"): True}


def test_reparenting(spark):
    rows = [("d", "big", f"m{k:02}", 30 - k) for k in range(12)] + [("d", "mid", f"n{k}", k) for k in range(8)] + [("d", "s1", None, None), ("d", "s2", "t", 3), ("d", "s3", None, None), ("d", "s4", None, None)]
    groups = spark.createDataFrame([(d, r, m, 0, c) for d, r, m, c in rows], "die_id string, rep string, member string, size int, match_count int")
    relation = spark.createDataFrame([("d", "s1", "mid"), ("d", "s2", "m11"), ("d", "s3", "m00"), ("d", "s4", "s2")], "die_id string, item string, other string")
    got = {r.rep: r.new_rep for r in grouping.reparent(groups, relation).collect()}
    assert got == {"big": "big", "mid": "mid", "s1": "mid", "s2": "big", "s3": "s3", "s4": "big"}


def test_homography():
    rng = np.random.default_rng(0)
    src = rng.uniform(0, 600, (40, 2))
    h = np.array([[0.9, -0.1, 5], [0.12, 1.05, -3], [1e-5, 2e-5, 1]])
    p = np.c_[src, np.ones(40)] @ h.T
    dst = p[:, :2] / p[:, 2:]
    dst[:10] += rng.uniform(50, 200, (10, 2))
    got, mask = grouping.homography(src, dst)
    assert mask.sum() == 30 and not mask[:10].any() and np.allclose(got, h, atol=1e-3)
    assert grouping.homography(src[:3], dst[:3])[0] is None and grouping.scale_distortion(None) == math.inf and grouping.scale_distortion(np.eye(3)) == math.inf
    assert abs(grouping.scale_distortion(np.diag([2.0, 2.0, 1.0])) - 2) < 1e-9


def test_verify_matches(spark):
    rows = [("p", float(x), float(y), x + 5.0, y - 2.0) for x in range(0, 50, 10) for y in range(0, 50, 10)] + [("q", 1.0, 1.0, 2.0, 2.0)]
    got = {r.pair: r.inliers for r in grouping.verify_matches(spark.createDataFrame(rows, "pair string, x double, y double, x2 double, y2 double")).collect()}
    assert got == {"p": 25, "q": 0}


def test_pips(spark):
    face = np.full((200, 200), 220, dtype=np.uint8)
    for y, x in ((50, 50), (50, 150), (150, 50)):
        face[(np.add.outer((np.arange(200) - y) ** 2, (np.arange(200) - x) ** 2)) < 17**2] = 20
    face[180:183, 180:183] = 10
    rows = [("a.jpg", 200, 200, bytearray(face.tobytes())), ("b.jpg", 200, 200, bytearray(np.full((200, 200), 90, dtype=np.uint8).tobytes()))]
    counted = grouping.count_pips(spark.createDataFrame(rows, "file string, width int, height int, grey binary"))
    assert {r.file: r.num_pips for r in counted.collect()} == {"a.jpg": 3, "b.jpg": 0}
    assert {(r.num_pips, r.rep, r.size) for r in grouping.pip_groups(counted).collect()} == {(3, "a.jpg", 1), (0, "b.jpg", 1)}


def test_die_is_found(spark):
    reference = np.zeros((240, 320, 3), dtype=np.uint8)
    photo = lambda *boxes: bytearray(np.where(sum(((np.arange(240) >= y)[:, None] & (np.arange(240) < y + h)[:, None] & (np.arange(320) >= x) & (np.arange(320) < x + w)) for x, y, w, h in boxes)[:, :, None] > 0, 200, 0).astype(np.uint8).repeat(3, axis=2).tobytes())
    rows = [("die.jpg", 320, 240, 3, photo((100, 80, 64, 60))), ("strip.jpg", 320, 240, 3, photo((0, 100, 300, 8), (200, 150, 60, 60))), ("none.jpg", 320, 240, 3, photo((0, 0, 1, 1))), ("huge.jpg", 320, 240, 3, photo((0, 0, 320, 240))), ("size.jpg", 10, 10, 3, bytearray(300))]
    images = spark.createDataFrame(rows, "file string, width int, height int, channels int, data binary")
    got = {r.file: r for r in imaging.detect(images, (320, 240, 3, reference.tobytes()), distance=8, factor=4).collect()}
    assert (got["die.jpg"].x_min, got["die.jpg"].y_min, got["die.jpg"].x_max, got["die.jpg"].y_max) == (100, 80, 160, 136)
    assert got["strip.jpg"].x_min == 200 and got["none.jpg"].not_found == "no region" and got["huge.jpg"].not_found.startswith("region of") and "reference" in got["size.jpg"].not_found
    crop = imaging.crop_bounds(spark.createDataFrame([got["die.jpg"]], imaging.RESULT), 320, 240, 100).first()
    assert crop.crop_x.high - crop.crop_x.low == 100 and crop.crop_y.high - crop.crop_y.low == 100


def test_charts_report_missing_series(spark):
    c = spark.createDataFrame([("x", ["a", "b"])], "chart_id string, data_ids array<string>")
    h = spark.createDataFrame([("a", 1, 1.0)], "data_id string, side int, p double")
    with pytest.raises(ValueError, match="b"):
        charts.lookup(c, h)
    rec = charts.records(spark.createDataFrame([("d", 2, 0.5, 0.4, 0.6), ("d", 1, 0.5, 0.4, 0.6)], f"die_id string, {HIST}")).first()
    assert [x["side"] for x in json.loads(rec.json)] == [1, 2]


# --- p-values over the whole range ---------------------------------------------------


def survival(x, dof):
    """By the trapezoid rule over the density, in logarithms."""
    import math

    a, width = dof / 2, math.sqrt(2 * dof)
    t = np.linspace(x, max(x, dof) + 60 * width + 200, 800_001)
    with np.errstate(divide="ignore"):
        logs = (a - 1) * np.log(t / 2) - t / 2 - math.lgamma(a) - math.log(2)
    y = np.exp(logs)
    return float(((y[1:] + y[:-1]) / 2).sum() * (t[1] - t[0]))


def test_chi2_survival_at_any_size(spark):
    from rollstats.functions.scalars import chi2_survival

    cases = [(1500.0, 2000), (2000.0, 2000), (2150.0, 2000), (20_000.0, 20_000), (20_400.0, 20_000), (19_500.0, 20_000), (1e6 + 2000, 1_000_000), (58.36086775, 19), (3.0, 5), (80.0, 5), (1500.0, 700)]
    got = spark.createDataFrame(cases, "x double, dof int").select("x", "dof", chi2_survival(F.col("x"), F.col("dof")).alias("p")).collect()
    for r in got:
        assert abs(r.p - survival(r.x, r.dof)) < 1e-6 + 1e-4 * r.p, r
    assert next(r.p for r in got if r.x == 1500 and r.dof == 2000) > 0.999999


# --- photos ---------------------------------------------------------------------------


def plain_die(diff, distance, threshold):
    """The scan pixel by pixel, as it is described."""
    h, w = diff.shape
    hot = diff > threshold
    window, seen, target = [], set(), distance**2
    for y in range(distance // 2, h, distance):
        for x in range(w):
            window.append((x, y) if hot[y, x] and (x, y) not in seen else None)
            window = window[-2 * distance :]
            if sum(p is not None for p in window) <= distance // 2:
                continue
            active = {p for p in window[-(distance // 2) or None :] if p}
            region = set()
            while active:
                i, j = active.pop()
                seen.add((i, j))
                if hot[j, i]:
                    region.add((i, j))
                    active |= {(a, b) for a in range(max(0, i - 1), min(w, i + 2)) for b in range(max(0, j - 1), min(h, j + 2))} - seen
            if len(region) > 5 * target:
                return {"not_found": f"region of {len(region)} pixels"}
            xs, ys = [p[0] for p in region], [p[1] for p in region]
            dx, dy = max(xs) - min(xs), max(ys) - min(ys)
            if dy and dx and max(dx / dy, dy / dx) < 2 and 2 * target <= dx * dy < 7 * target and len(region) >= 1.5 * target:
                return {"x_min": min(xs), "y_min": min(ys), "x_max": max(xs), "y_max": max(ys), "npx": len(region)}
            window = []
    return {"not_found": "no region"}


def test_scan_equals_a_plain_loop_on_random_masks():
    from rollstats.operators.imaging import find_die

    rng = np.random.default_rng(0)
    results = []
    for k in range(120):
        diff = (rng.random((60, 70)) < rng.choice([0.02, 0.2, 0.35])) * 250
        for _ in range(rng.integers(0, 5)):  # blobs, some of them in pieces
            x, y, a, b = rng.integers(0, 50), rng.integers(0, 40), rng.integers(3, 22), rng.integers(3, 22)
            diff[y : y + b, x : x + a] = np.where(rng.random((b, a))[: diff[y : y + b, x : x + a].shape[0], : diff[y : y + b, x : x + a].shape[1]] < rng.choice([0.6, 0.95, 1]), 250, 0)
        distance = int(rng.choice([7, 8, 10]))
        got = find_die(diff, distance, 180)
        assert got == plain_die(diff, distance, 180), k
        results.append("npx" in got)
    assert 10 < sum(results) < 110


def test_images_are_made_smaller_by_their_middle_pixels():
    from rollstats.operators.imaging import smaller

    image = np.arange(7 * 11).reshape(7, 11, 1).astype(np.uint8)
    assert smaller(image, 3)[..., 0].tolist() == [[image[r, c, 0] for c in (1, 5, 9)] for r in (1, 5)]


def test_failures_are_rows(spark):
    from rollstats.operators.grouping import count_pips, verify_matches

    bad = [("p", float("nan"), float("nan"), 1.0, 1.0)] * 5
    good = [("q", float(x), float(y), 2.0 * x, 2.0 * y) for x, y in ((0, 0), (9, 1), (3, 8), (7, 7), (2, 5))]
    got = {r.pair: r for r in verify_matches(spark.createDataFrame(bad + good, "pair string, x double, y double, x2 double, y2 double")).collect()}
    assert got["p"].inliers == 0 and got["q"].inliers == 5 and got["q"].error is None
    images = spark.createDataFrame([("a", 4, 4, b"short"), ("b", 4, 4, bytes(16)), ("c", 4, 4, None)], "file string, width int, height int, grey binary")
    assert {r.file: r.num_pips for r in count_pips(images).collect()} == {"a": None, "b": 0, "c": None}


def test_a_histogram_of_too_many_sides_is_refused(spark, monkeypatch):
    from rollstats.operators import stats

    monkeypatch.setattr(stats, "MAX_SIDES", 3)
    h = spark.createDataFrame([(k, 0.25, 0.2, 0.3) for k in range(4)], "side int, p double, ci_low double, ci_high double")
    with pytest.raises(ValueError, match="over 3 sides"):
        stats.combine(h, h)


def test_leaders_on_a_long_chain_and_on_large_sets(spark):
    n = 3000
    chain = [(k, k - 1) for k in range(1, n)]
    items = spark.createDataFrame([(k,) for k in range(n + 5)], "item long")
    matches = spark.createDataFrame(chain, "item long, other long")
    want = {k: k if k % 2 == 0 or k >= n else k - 1 for k in range(n + 5)}
    assert dict(map(tuple, grouping.leaders(items, matches).collect())) == want
    short = spark.createDataFrame([(k, k - 1) for k in range(1, 12)] + [(22, 20), (22, 21), (21, 20)], "item long, other long")
    few = spark.createDataFrame([(k,) for k in range(24)], "item long")
    got = dict(map(tuple, grouping.leaders(few, short, set_edges=5).collect()))
    assert got == {**{k: k - k % 2 for k in range(12)}, **{k: k for k in range(12, 24)}, 21: 20, 22: 20}


def plain_leaders(items, matches):
    """The loop: each item in order joins the first leader it matches."""
    of, heads = {}, set()
    by_item = {}
    for i, j in matches:
        by_item.setdefault(i, []).append(j)
    for i in sorted(items):
        of[i] = min((j for j in by_item.get(i, ()) if j in heads), default=i)
        if of[i] == i:
            heads.add(i)
    return of


def test_a_chain_of_300_000_items_takes_few_rounds(spark, monkeypatch):
    n, rounds = 300_000, []
    decide = grouping._decided_in_order
    monkeypatch.setattr(grouping, "_decided_in_order", lambda *a: rounds.append(a[0]) or decide(*a))
    ids = spark.range(n).select(F.col("id").alias("item"))
    got = grouping.leaders(ids, ids.where("item > 0").select("item", (F.col("item") - 1).alias("other")))
    assert got.where(F.col("leader") != F.col("item") - F.col("item") % 2).isEmpty() and got.count() == n
    assert rounds.count("component") == 3  # 300,000 items and 299,999 matches in blocks of 200,000


@pytest.mark.parametrize("seed, kind", [(1, "long"), (2, "string"), (3, "long")])
def test_leaders_in_blocks_equal_the_loop(spark, seed, kind):
    rng = random.Random(seed)
    name = (lambda k: f"f{k:04}") if kind == "string" else (lambda k: k)
    n = 240
    # Random matches, a hub that most items match, a hub that matches most items, and a second set.
    match = {(i, j) for i in range(n) for j in range(i) if rng.random() < (0.03 if seed < 3 else 0.2)}
    match |= {(i, 7) for i in range(8, 120) if rng.random() < 0.5} | {(n - 1, j) for j in range(n - 1) if rng.random() < 0.6} | {(i, i - 1) for i in range(1001, 1060)}
    items = [*range(n), *range(1000, 1062)]
    want = {name(k): name(v) for k, v in plain_leaders(items, match).items()}
    frame = spark.createDataFrame([(name(k),) for k in items], f"item {kind}")
    edges = spark.createDataFrame([(name(i), name(j)) for i, j in match], f"item {kind}, other {kind}")
    assert dict(map(tuple, grouping.leaders(frame, edges, set_edges=len(match) // 6).collect())) == want


def test_blocks_after_the_first_hold_open_items_only(spark, monkeypatch):
    """A dense set of 40 blocks of matches takes a few rounds: what the first leaders match is gone before the next block is cut."""
    rng, rounds = random.Random(5), []
    match = [(i, j) for i in range(400) for j in range(i) if rng.random() < 0.1]
    decide = grouping._decided_in_order
    monkeypatch.setattr(grouping, "_decided_in_order", lambda *a: rounds.append(a[0]) or decide(*a))
    items = spark.createDataFrame([(k,) for k in range(400)], "item long")
    got = grouping.leaders(items, spark.createDataFrame(match, "item long, other long"), set_edges=len(match) // 40)
    assert dict(map(tuple, got.collect())) == plain_leaders(range(400), match)
    assert rounds.count("component") <= 10


@pytest.mark.parametrize("set_items", [16, 1 << 14])
def test_leaders_of_codes_equal_the_loop(spark, set_items):
    rng = random.Random(set_items)
    rows = [(k % 3, k, rng.getrandbits(12), rng.getrandbits(12)) for k in range(240)]
    rows += [(rng.randrange(3), 240 + k, *rng.choice(rows)[2:]) for k in range(200)] + [(None, 500, 1, 1), (None, 501, 1, 1), (1, 502, None, 1)]
    near = lambda a, b: None not in (*a, *b) and a[0] == b[0] and ((a[2] ^ b[2]).bit_count() + (a[3] ^ b[3]).bit_count()) <= 7
    want = plain_leaders([r[1] for r in rows], [(a[1], b[1]) for a in rows for b in rows if b[1] < a[1] and near(a, b)])
    frame = spark.createDataFrame(rows, "image int, item long, hi long, lo long")
    assert dict(map(tuple, grouping.leaders_of_codes(frame, 7, set_items).collect())) == want
    assert grouping.leaders_of_codes(frame.limit(0), 7).count() == 0


def test_running_totals_over_ranges(spark):
    from rollstats.operators.ordered import running_total

    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), k, rng.randint(-3, 9)) for k in range(5000)]
    got = running_total(spark.createDataFrame(rows, "die string, k long, v long").repartition(6), ["die"], ["k"], F.col("v"), "before").collect()
    at, want = {}, {}
    for die, k, v in rows:
        want[k] = at.get(die, 0)
        at[die] = want[k] + v
    assert {r.k: r.before for r in got} == want


def test_bootstrap_of_a_die_with_100_000_sides(spark):
    """In blocks of a few hundred sides; the same numbers however the blocks are spread."""
    sides = 100_000
    df = spark.range(4 * sides).select(F.lit("d").alias("die_id"), (F.col("id") % sides).cast("int").alias("side"))
    blocks = stats.draw_blocks(rolls.label_counts(df), 200)
    sizes = [r[0] for r in blocks.groupBy("block").count().select("count").collect()]
    assert len(sizes) == 256 and max(sizes) < 2 * sides / 256
    got = stats.bootstrap(df, resamples=200)
    assert got.count() == sides
    mean = got.agg(F.avg("ci_low"), F.avg("ci_high"), F.max("p")).first()
    # A count of 4 in 400,000 is nearly a Poisson number with mean 4: 0.949 of them are 7 at most, 0.979 are 8.
    assert abs(mean[0] * 4 * sides - 1) < 0.1 and 7 < mean[1] * 4 * sides < 8 and mean[2] == 1 / sides


def test_bootstrap_does_not_depend_on_the_split(spark, monkeypatch):
    monkeypatch.setattr(stats, "BLOCK_SIDES", 3)
    rng = random.Random(1)
    df = dice(spark, a=[min(19, int(rng.expovariate(0.2))) for _ in range(2000)], b=[1] * 5, c=[1, 2] * 400)
    one = sorted(map(tuple, stats.bootstrap(df.repartition(1)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        other = sorted(map(tuple, stats.bootstrap(df.repartition(5, "side")).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert one == other
    for die, side, p, low, high in one:
        n = {"a": 2000, "b": 5, "c": 800}[die]
        width = 1.6449 * math.sqrt(p * (1 - p) / n)
        assert abs(low - max(0, p - width)) < 0.12 / math.sqrt(n) + 1 / n and abs(high - min(1, p + width)) < 0.12 / math.sqrt(n) + 1 / n


def test_smallest_hashes_leave_few_rows_a_task(spark, monkeypatch):
    """At most ``size`` rows a die, size and task come out, and the smallest are among them."""
    df = spark.range(0, 40_000, 1, 4).select(F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 5).cast("string")).alias("die_id"), F.col("id").alias("seq"), (F.col("id") % 7).cast("int").alias("side"))
    want = stats.subsample_histogram(df, [16, 100]).collect()
    for held in (1 << 18, 500):
        monkeypatch.setattr(stats, "HELD", held)
        kept = stats.smallest_hashes(df, [16, 100], "7").withColumn("task", F.spark_partition_id())
        most = {r["size"]: r["m"] for r in kept.groupBy("task", "die_id", "size").count().groupBy("size").agg(F.max("count").alias("m")).collect()}
        assert most == {16: 16, 100: 100}
        assert sorted(stats.subsample_histogram(df, [16, 100]).collect()) == sorted(want)
    ranked = df.toPandas()
    import hashlib

    for size in (16, 100):
        ranked["h"] = [int(hashlib.md5(f"7-{size}-{s}".encode()).hexdigest()[:8], 16) for s in ranked["seq"]]
        first = ranked.sort_values(["h", "seq"]).groupby("die_id").head(size)
        hot = first[first["die_id"] == "hot"]["side"]
        got = {r.side: r.freq for r in want if r.die_id == "hot" and r["size"] == size}
        assert all(abs(f - (hot == s).sum() * hot.nunique() / size) < 1e-9 for s, f in got.items())


@pytest.mark.parametrize("bits, part_bits", [(64, 16), (32, 8)])
def test_indexed_neighbours_equal_all_pairs(spark, bits, part_bits):
    """Codes with near ones, with few near ones, and with none: the same distances, from far fewer comparisons where near ones are."""
    rng = np.random.default_rng(bits)
    word = lambda n: rng.integers(0, 1 << (bits - 1), n).astype(object) * 2 + rng.integers(0, 2, n).astype(object)
    signed = lambda x: int(x) - (1 << 64) if int(x) >= 1 << 63 else int(x)
    rows_q, rows_o = [], []
    for pair in range(2):
        hi, lo = word(400), word(400)
        rows_o += [(pair, k, signed(a), signed(b)) for k, (a, b) in enumerate(zip(hi, lo))]
        flip = lambda x: x ^ (1 << int(rng.integers(0, bits)))
        rows_o += [(pair, 1000 + k, signed(flip(a)), signed(flip(b))) for k, (a, b) in enumerate(zip(hi[:300], lo[:300]))]
        rows_q += [(pair, k, signed(flip(a)), signed(flip(b))) for k, (a, b) in enumerate(zip(hi, lo))]
    rows_q += [(7, 1, 5, 5), (8, 1, 5, 5)]
    rows_o += [(7, 1, 5, 5), (8, 1, 5, 5), (8, 2, 5, 5), (8, 3, 4, 5)]  # one neighbour only; equal ones
    q = spark.createDataFrame(rows_q, "pair int, desc_id int, hi long, lo long")
    o = spark.createDataFrame(rows_o, "pair int, other_id int, hi long, lo long")
    got = grouping.nearest_two_indexed(q, o, bits, part_bits).collect()
    want = grouping.nearest_two(q, o).collect()
    assert sorted((r.pair, r.desc_id, r.d1, r.d2) for r in got) == sorted((r.pair, r.desc_id, r.d1, r.d2) for r in want)
    compared = {(r.pair, r.desc_id): r.compared for r in got}
    assert (8, 1) in compared and (7, 1) not in compared
    near = [n for (pair, k), n in compared.items() if pair < 2 and k < 300]
    assert sum(near) < 0.2 * 700 * len(near)  # a fifth of all pairs at most, where two near ones are
    assert bits == 32 or all(compared[pair, k] == 700 for pair in range(2) for k in range(300, 400))  # the rest met all


def plain_reparent(rows, relation, tries):
    """The loop over a die's small groups."""
    members, out = {}, {}
    for rep, member, n in rows:
        members.setdefault(rep, [])
        if member is not None:
            members[rep].append((n, member))
    order = sorted(members, key=lambda r: (-len(members[r]), r))
    edge = next((k for k in range(1, len(order)) if len(members[order[k]]) < len(members[order[0]]) / 4), len(order) - 1)
    large = order[:edge] if len(order) > 1 else order
    for rep in order[edge:] if len(order) > 1 else []:
        for big in large:
            if any((rep, t) in relation for t in [big, *(m for _, m in sorted(members[big])[:tries])]):
                members[big] += [(0, rep), *members[rep]]
                out[rep] = big
                break
    return {rep: out.get(rep, rep) for rep in order}


def test_reparenting_in_rounds_equals_the_loop(spark):
    rng = random.Random(5)
    rows, relation, want = [], [], {}
    for die in ("a", "b", "c", "one"):
        own = []
        for g in range(1 if die == "one" else 14):
            size = rng.randint(15, 40) if g < 4 else rng.randint(0, 3)
            own += [(f"r{g:02}", f"m{g:02}-{k}", rng.randint(0, 5)) for k in range(size)] or [(f"r{g:02}", None, None)]
        names = [f"r{g:02}" for g in range(14)] + [m for _, m, _ in own if m]
        match = {(f"r{rng.randint(4, 13):02}", rng.choice(names)) for _ in range(40)}
        rows += [(die, r, m, 0, n) for r, m, n in own]
        relation += [(die, *x) for x in match]
        want |= {(die, rep): new for rep, new in plain_reparent(own, match, 3).items()}
    groups = spark.createDataFrame(rows, "die_id string, rep string, member string, size int, match_count int").repartition(4)
    pairs = spark.createDataFrame(relation, "die_id string, item string, other string")
    assert {(r.die_id, r.rep): r.new_rep for r in grouping.reparent(groups, pairs, tries=3).collect()} == want
    assert sum(k[1] != v for k, v in want.items()) > 5


@pytest.mark.parametrize("tile", [1, 4, 7, 256])
def test_regions_across_tiles_equal_the_plain_fill(spark, tile):
    from rollstats.operators import tiles

    rng = random.Random(tile)
    pixels = {(image, rng.randint(-5, 40), rng.randint(-5, 40)) for image in (1, 2) for _ in range(700)}
    pixels |= {(3, k, k) for k in range(60)} | {(3, k, 59 - k) for k in range(20)} | {(3, 10, k) for k in range(40, 59)}  # pieces that meet at corners, and not
    left, want = set(pixels), {}
    for start in sorted(pixels):
        todo = [start] if start in left else []
        left.discard(start)
        while todo:
            i, y, x = todo.pop()
            want[i, y, x] = start[1:]
            for n in [(i, y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if n in left:
                    left.discard(n)
                    todo.append(n)
    got = tiles.regions(spark.createDataFrame(sorted(pixels) + [(1, *k[1:]) for k in pixels if k[0] == 1], "image int, y int, x int"), tile)
    assert {(r.image, r.y, r.x): (r.region_y, r.region_x) for r in got.collect()} == want
    assert got.count() == len(pixels)


def test_rolled_up_fairness(spark):
    df = dice(spark, a=[1, 2, 2], b=[1, 1, 2, 3], c=[5, 5])
    names = spark.createDataFrame([("a", "x", 6), ("b", "x", 8), ("c", "y", 6)], "die_id string, maker string, sides int")
    one = {r.die_id: r for r in stats.chi_square(df).collect()}
    rows = {(r.maker, r.sides, r.level): r for r in stats.rolled_up(df, names, ["maker", "sides"]).collect()}
    assert set(rows) == {("x", 6, 0), ("x", 8, 0), ("y", 6, 0), ("x", None, 1), ("y", None, 1), (None, None, 2)}
    x, whole = rows["x", None, 1], rows[None, None, 2]
    assert (x.dice, x.n, x.dof) == (2, 7, 3) and abs(x.statistic - one["a"].statistic - one["b"].statistic) < 1e-12
    assert (whole.dice, whole.n, whole.dof) == (3, 9, 3) and abs(x.p - scalars_p(spark, x.statistic, 3)) < 1e-12


def scalars_p(spark, x, dof):
    return spark.range(1).select(scalars.chi2_survival(F.lit(x), F.lit(dof))).first()[0]


def test_text_of_heatmap_cells(spark):
    cells = spark.createDataFrame([(0,), (100,), (101,), (254,), (None,)], "grey int")
    assert [r.t for r in cells.select(scalars.text_grey(F.col("grey")).alias("t")).collect()] == [40, 140, 61, 214, None]


def test_homography_of_many_points_holds_no_square_of_them():
    """Left vectors of 4,000 points would be 8,000 by 8,000 numbers: half a gigabyte."""
    import tracemalloc

    rng = np.random.default_rng(1)
    src = rng.uniform(0, 900, (4000, 2))
    tracemalloc.start()
    h, mask = grouping.homography(src, src * 2 + 3, rounds=5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert mask.all() and np.allclose(h, [[2, 0, 3], [0, 2, 3], [0, 0, 1]], atol=1e-6) and peak < 50 << 20


def test_chi2_line_rounds_like_c(spark):
    from rollstats.functions.scalars import chi2_line

    values = [k / 1e9 for k in range(500, 10**9, 9_973_000)]
    rows = spark.createDataFrame([(v,) for v in values], "p double")
    got = [r.line for r in rows.select(chi2_line(F.lit(7), F.col("p")).alias("line")).collect()]
    assert got == [f"N=7 p={v:f} ({int(v * 100)}% chance the data is from a random source)" for v in values]


def test_smallest_hashes_hold_twice_the_limit_at_most(spark, monkeypatch):
    """Many dice of few rolls: nothing can be left out, so rows are passed on as soon as the limit is reached."""
    from rollstats.operators import stats

    monkeypatch.setattr(stats, "HELD", 1000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    try:
        df = spark.range(6000, numPartitions=1).select(F.col("id").cast("string").alias("die_id"), F.col("id").alias("seq"), F.lit(1).alias("side"))
        kept = stats.smallest_hashes(df, [4], "7").withColumn("row", F.monotonically_increasing_id())
        ids = [int(r.die_id) for r in kept.orderBy("row").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(ids) == 6000 and max(ids[:1200]) < 1200  # the first rows leave before the later ones are read


def test_ranges_of_running_totals_are_cut_by_rows(spark, monkeypatch):
    from rollstats.operators import ordered

    monkeypatch.setattr(ordered, "RANGE_ROWS", 100)
    rows = spark.range(3000).select(F.lit("a").alias("die"), (F.col("id") * 7 % 3000).alias("k"))
    got = ordered.running_total(rows, ["die"], ["k"], F.lit(1).cast("long"), "before").withColumn("task", F.spark_partition_id()).collect()
    assert all(r.before == r.k for r in got) and len({r.task for r in got}) > 8  # not the few that their bytes ask for


def test_nearest_two_in_parts_with_copies(spark, monkeypatch):
    monkeypatch.setattr(grouping, "PART_CODES", 8)
    rng = random.Random(9)
    q = [(k % 2, k, rng.getrandbits(10), rng.getrandbits(10)) for k in range(60)]
    o = [(k % 2, rng.getrandbits(10), rng.getrandbits(10)) for k in range(60)]
    q, o = q + [(0, 100, *q[0][2:]), (7, 101, 1, 1), (8, 102, 1, 1)], o + o[:20] + [(7, 1, 1)]
    want = {}
    for pair, k, hi, lo in q:
        d = sorted((hi ^ h).bit_count() + (lo ^ w).bit_count() for p, h, w in o if p == pair)
        if len(d) > 1:
            want[pair, k] = tuple(d[:2])
    got = grouping.nearest_two(spark.createDataFrame(q, "pair int, desc_id long, hi long, lo long"), spark.createDataFrame(o, "pair int, hi long, lo long"))
    assert {(r.pair, r.desc_id): (r.d1, r.d2) for r in got.collect()} == want
    # Parts: a task a group of parts, where the join made one group a pair.
    assert "FlatMapCoGroups" in got._jdf.queryExecution().toString()


def test_dice_of_one_size_share_their_draws(spark, monkeypatch):
    """As many rows of draws as the different sizes have rolls, in tasks of like numbers of draws; equal to the plain loop."""
    import hashlib

    monkeypatch.setattr(stats, "DRAW_CHUNK", 7)
    monkeypatch.setattr(stats, "TASK_DRAWS", 500)
    rng = random.Random(3)
    rolled = {f"d{k:02d}": [rng.randint(1, 6) for _ in range((5, 12)[k % 2])] for k in range(40)} | {"hot": [rng.randint(1, 50) for _ in range(300)], "one": [4]}
    df = dice(spark, **rolled)
    sizes = df.groupBy("die_id").agg(F.count(F.lit(1)).alias("size"))
    draws = stats.draw_counts(sizes, 20, "7")
    counts = draws.withColumn("task", F.spark_partition_id()).collect()
    assert len(counts) <= 5 + 12 + 300 + 1 and sum(sum(r.hits) for r in counts) == 20 * (5 + 12 + 300 + 1)
    assert len({r.task for r in counts}) > 6
    want = {}
    for die, sides in rolled.items():
        n = len(sides)
        drawn = [[sides[int(hashlib.md5(f"7-{b}-{i}".encode()).hexdigest()[:8], 16) % n] for i in range(n)] for b in range(20)]
        for side in {s for d in drawn for s in d}:
            ns = sorted(d.count(side) for d in drawn)
            want[die, side] = tuple((ns[at] + (ns[at + 1] - ns[at]) * part) / n for at, part in ((0, 0.95), (18, 0.05)))
    got = {(r.die_id, r.side): (r.ci_low, r.ci_high) for r in stats.bootstrap_deterministic(df.repartition(3)).collect()}
    assert got.keys() == want.keys() and all(abs(x - y) < 1e-12 for k in want for x, y in zip(got[k], want[k]))
    # Draws of a long die are as many as its rolls: they are not broadcast.
    plan = stats.bootstrap_deterministic(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [size" in plan
