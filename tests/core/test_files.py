"""Readers, writers, streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollstats.sources import files, sinks
from rollstats.streaming import live


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_labels_keep_their_order_and_skip_comments(spark, tmp_path):
    put(tmp_path / "d1" / "labels.csv", "# # one\n# two\n3\n 1 \n2\n#x\n3")
    put(tmp_path / "d2" / "labels.csv", "5\n")
    put(tmp_path / "d3" / "labels.csv", "")
    at = str(tmp_path / "*" / "labels.csv")
    get = lambda **k: sorted((r.die_id, r.seq, r.side) for r in files.read_labels(spark, at, **k).collect())
    assert get() == [("d1", 1, 3), ("d1", 2, 1), ("d1", 3, 2), ("d1", 4, 3), ("d2", 1, 5)]
    assert get(num_labels=1) == [("d1", 1, 3), ("d2", 1, 5)] and get(num_labels=0) == [] and get(num_labels=-3) == [("d1", 1, 3)]


@pytest.mark.parametrize("text", ["1\n\n2", "1\nx\n"])
def test_labels_that_are_no_numbers_fail(spark, tmp_path, text):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        files.read_labels(spark, put(tmp_path / "d" / "labels.csv", text)).collect()


def test_histograms_by_position_and_by_name(spark, tmp_path):
    old = put(tmp_path / "d" / "old.csv", "X,p(X),5%,95%\n1,0.5,0.4,0.6\n1,0.7,0.6,0.8\n2,0.3,0.2,0.4\n")
    new = put(tmp_path / "d" / "new.csv", "ci_high,side,p,ci_low\n0.6,1,0.5,0.4\n")
    assert {(r.name, r.side, r.p) for r in files.read_histograms(spark, old).collect()} == {("old", 1, 0.7), ("old", 2, 0.3)}
    assert tuple(files.read_histogram_by_name(spark, new).first()) == (1, 0.5, 0.4, 0.6)


def test_groups_round_trip(spark, tmp_path):
    lists = [["b", "a"], ["c"]]
    groups = files.read_groups(spark, put(tmp_path / "die" / "summary.json", json.dumps(lists)))
    assert sorted(tuple(r) for r in groups.collect()) == [("die", 0, 0, "b"), ("die", 0, 1, "a"), ("die", 1, 0, "c")]
    assert json.loads(sinks.groups_json(groups).first().value) == lists
    assert {(r.file, r.x, r.y) for r in sinks.tiles(groups).collect()} == {("b", 0, 0), ("a", 90, 0), ("c", 0, 90)}


def test_chart_index(spark, tmp_path):
    index = {"s": {"title": "T", "filenames": ["a", "b"], "fairValue": 0.1}, "t": {"title": "U", "filenames": ["c"], "names": ["n"]}}
    got = {r.chart_id: r for r in files.read_chart_index(spark, put(tmp_path / "i.json", json.dumps(index))).collect()}
    assert got["s"].fairValue == 0.1 and got["s"].names is None and got["t"].filenames == ["c"]


def test_written_labels_read_back(spark, tmp_path):
    seq = spark.createDataFrame([("d", 2, 6), ("d", 1, 4), ("e", 1, 1)], "die_id string, seq long, label int")
    sinks.write_labels(seq, str(tmp_path / "out"), "made")
    assert (tmp_path / "out" / "die_id=d" / "labels.csv").read_text() == "# made\n4\n6" and (tmp_path / "out" / "die_id=e" / "labels.csv").read_text() == "# made\n1"
    assert sorted(f.name for f in (tmp_path / "out" / "die_id=d").iterdir() if f.name[0] != ".") == ["labels.csv"]
    got = files.read_labels(spark, str(tmp_path / "out" / "*" / "labels.csv"))
    assert sorted((r.die_id, r.seq, r.side) for r in got.collect()) == [("die_id=d", 1, 4), ("die_id=d", 2, 6), ("die_id=e", 1, 1)]


def test_written_histograms(spark, tmp_path):
    h = spark.createDataFrame([("d", 1, 1 / 3, 0.1, 0.5)], f"die_id string, {files.HISTOGRAM}")
    sinks.write_histograms(h, str(tmp_path / "out"))
    [part] = (tmp_path / "out" / "die_id=d").glob("*.csv")
    assert part.read_text() == "side,p,ci_low,ci_high\n1,0.33333,0.10000,0.50000\n"


def test_report(spark):
    charts = spark.createDataFrame([("c", "a $1 chart", ["d"])], "chart_id string, title string, data_ids array<string>")
    h = spark.createDataFrame([("d", 1, 1.0, 0.9, 1.1)], f"data_id string, {files.HISTOGRAM}")
    page = sinks.report(charts, h, "Dice")
    assert '"a $1 chart"' in page and '"ci_low": 0.9' in page


def test_images_are_listed(spark, tmp_path):
    for name in ("1.JPG", "2.jpg", "reference.JPG", "notes.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r.file for r in files.list_images(spark, str(tmp_path), "Reference.jpg").collect()) == ["1.JPG", "2.jpg"]


def test_running_counts(spark, tmp_path):
    put(tmp_path / "in" / "d" / "labels.csv", "1\n2\n1\n")
    counts = live.running_counts(live.label_stream(spark, str(tmp_path / "in" / "*")))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    put(tmp_path / "in" / "d" / "more.csv", "2\n")
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("running").collect()) == [("d", 1, 2), ("d", 2, 2)]


def test_snapshots_and_windows(spark, tmp_path):
    put(tmp_path / "in" / "d" / "labels.csv", "1\n2\n1\n")
    q = live.snapshots(live.label_stream(spark, str(tmp_path / "in" / "*")), str(tmp_path / "out"), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    ts = spark.createDataFrame([("d", 1, "2024-01-01 00:10:00"), ("d", 1, "2024-01-01 00:50:00"), ("d", 1, "2024-01-01 01:10:00")], "die_id string, side int, ts string")
    timed = ts.withColumn("ts", ts.ts.cast("timestamp"))
    assert sorted(r.n for r in live.windowed_counts(timed).collect()) == [1, 2]
    assert np.isfinite(1.0)


def test_photo_stream_resumes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: live.photo_stream(spark, str(tmp_path / "in")).select("file").writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start().awaitTermination()
    (tmp_path / "in" / "1.JPG").write_bytes(b"x")
    (tmp_path / "in" / "notes.txt").write_bytes(b"x")
    run()
    (tmp_path / "in" / "2.jpg").write_bytes(b"y")
    run()
    assert sorted(r.file for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1.JPG", "2.jpg"]


def test_diameters_are_read(spark, tmp_path):
    at = put(tmp_path / "d20" / "diameters.txt", "side\t1\t2\nopp\t20\t19\nmm\t19.5\t19.6\ndd\t-.1\t0.0\npside\t1.1\t0.9\npopp\t1.0\t1.2\n\nnotes\t1")
    assert [tuple(r) for r in files.read_diameters(spark, at).orderBy("side").collect()] == [("d20", 1, 20, 19.5, -0.1, 1.1, 1.0), ("d20", 2, 19, 19.6, 0.0, 0.9, 1.2)]


def test_a_long_label_file_is_written_from_ranges_and_read_in_splits(spark, tmp_path):
    n = 1_000_000
    side = lambda k: (k * 7919) % 20 + 1
    seq = spark.range(0, n, 1, 6).select(F.when(F.col("id") % 1000 == 0, "b").otherwise("a").alias("die_id"), (n - F.col("id")).alias("seq"), ((F.col("id") * 7919) % 20 + 1).cast("int").alias("label"))
    sinks.write_labels(seq, str(tmp_path / "out"), "made", label_file=None)
    sinks.write_labels(seq, str(tmp_path / "one"), "made")
    parts = [f for f in (tmp_path / "out" / "die_id=a").iterdir() if f.name.startswith("part-")]
    assert len(parts) > 4 and max(f.stat().st_size for f in parts) < 700_000
    text = (tmp_path / "one" / "die_id=a" / "labels.csv").read_text()
    assert text == "# made\n" + "\n".join(str(side(n - s)) for s in range(1, n + 1) if (n - s) % 1000)
    want = files.read_labels(spark, str(tmp_path / "one" / "*" / "labels.csv"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        split = files.read_labels(spark, str(tmp_path / "one" / "*" / "labels.csv"))
        in_parts = files.read_labels(spark, str(tmp_path / "out" / "*" / "part-*"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    plain = files.parse_labels(spark.createDataFrame([("die_id=a", text)], "die_id string, value string"))
    assert plain.exceptAll(split.where("die_id = 'die_id=a'")).isEmpty()
    assert want.count() == split.count() == n and want.exceptAll(split).isEmpty() and want.exceptAll(in_parts).isEmpty()


def test_splits_and_comments(spark, tmp_path):
    put(tmp_path / "d1" / "labels.csv", "# first\n" + "\n".join("# more" if k % 5 == 0 else str(k) for k in range(3000)) + "\n")
    put(tmp_path / "d2" / "labels.csv", "#" * 5000)
    put(tmp_path / "d3" / "labels.csv", "1\r\n2\r\n# x\r\n3")
    at = str(tmp_path / "*" / "labels.csv")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "777")
    try:
        get = lambda **k: sorted((r.die_id, r.seq, r.side) for r in files.read_labels(spark, at, **k).collect())
        kept = [k for k in range(3000) if k % 5]
        assert get() == [("d1", k + 1, v) for k, v in enumerate(kept)] + [("d3", k, k) for k in (1, 2, 3)]
        assert get(num_labels=2) == [("d1", 1, 1), ("d1", 2, 2), ("d3", 1, 1), ("d3", 2, 2)]
        assert get(num_labels=-2398) == [("d1", 1, 1), ("d1", 2, 2)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_groupings_of_a_member_a_line(spark, tmp_path):
    lists = {"d": [["r1", 'a "b" ],', "[c]", "é\n"], ["r2"], ["r3"] + [f"m{k}" for k in range(500)]], "e": [["only"]]}
    rows = [(die, g, m, f) for die, groups in lists.items() for g, members in enumerate(groups) for m, f in enumerate(members)]
    df = spark.createDataFrame(rows, "die_id string, group_idx int, member_idx int, file string").repartition(5)
    sinks.write_groups(df, str(tmp_path / "out"))
    for die, want in lists.items():
        text = (tmp_path / "out" / f"die_id={die}" / "summary.json").read_text()
        assert json.loads(text) == want and (len(want) == 1 or text.count("\n") == sum(map(len, want)) - 1)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = sorted(map(tuple, files.read_group_lines(spark, str(tmp_path / "out" / "*" / "summary.json")).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((f"die_id={d}", g, m, f) for d, g, m, f in rows)
    # Any list of lists reads as before, on one line or several.
    whole = files.read_groups(spark, str(tmp_path / "out" / "*" / "summary.json"))
    assert sorted(map(tuple, whole.collect())) == got


def test_acquisition_goes_on_after_a_restart(spark, tmp_path):
    schema = "rig string, at long, run long, ok boolean"

    def put_and_run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = live.acquire(stream, rolls=6, errors=2).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        query.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        out = spark.read.parquet(str(tmp_path / "out")).collect()
        return sorted((r.rig, r.at, r.number, r.file) for r in out)

    first = put_and_run([("a", 3, 1, True), ("a", 1, 1, True), ("a", 2, 1, False), ("b", 1, 1, False), ("b", 2, 1, False), ("b", 3, 1, True)])
    assert first == [("a", 1, 0, "00000.JPG"), ("a", 2, None, None), ("a", 3, 1, "00001.JPG"), ("b", 1, None, None), ("b", 2, None, None)]
    # The same run of rig a goes on at number 2 with one failure, rig b's stays at its end; both start anew in run 2.
    second = put_and_run([("a", 4, 1, True), ("a", 5, 1, False), ("a", 6, 1, True), ("b", 4, 1, True), ("a", 7, 2, True), ("b", 5, 2, True)])
    assert second[: len(first) - 2] == first[:3]
    new = [r for r in second if r not in first]
    assert new == [("a", 4, 2, "00002.JPG"), ("a", 5, None, None), ("a", 7, 3, "00003.JPG"), ("b", 5, 0, "00000.JPG")]
    third = put_and_run([("a", k, 2, True) for k in range(8, 20)])
    assert [r[2] for r in third if r[0] == "a" and r[1] > 7] == [4, 5]  # six photos, then no more


def test_the_last_of_repeated_sides_counts_over_splits(spark, tmp_path):
    lines = ["side,p,ci_low,ci_high", *(f"{k % 7},{k / 1000},0.0,1.0" for k in range(3000))]
    at = put(tmp_path / "h.csv", "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        got = {r.side: round(r.p * 1000) for r in files.read_histograms(spark, at).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {k % 7: k for k in range(2993, 3000)}


def test_short_dice_are_written_whole_by_tasks(spark, tmp_path, monkeypatch):
    """Parts that the driver joins are those of a range's ends and of long dice, however many dice there are."""
    odd = ["a b", "x/y", "q=1", "100%", "it's", "é", "{z}", "[w]", "^", 'say "x"', "c:\\d", "#1", "\x7f\t", "", None]
    rows = [(die, k, k % 6 + 1) for die in [f"d{n:04d}" for n in range(600)] + odd for k in range(3)] + [("long", k, k) for k in range(500)]
    df = spark.createDataFrame(rows, "die_id string, seq long, label int").repartition(5)
    monkeypatch.setattr(sinks, "HELD_BYTES", 2000, raising=False)
    joined, join = [], sinks.join_parts

    def watched(session, path, name):
        joined.extend({f.parent.name for f in (tmp_path / "one").glob("*/part-*")})
        join(session, path, name)

    monkeypatch.setattr(sinks, "join_parts", watched)
    sinks.write_labels(df, str(tmp_path / "one"), "made")
    sinks.write_labels(df, str(tmp_path / "parts"), "made", label_file=None)
    assert "die_id=long" in joined and len(joined) <= 2 * 8 + 1
    folders = sorted(f.name for f in (tmp_path / "parts").glob("die_id=*"))
    assert folders == sorted(f.name for f in (tmp_path / "one").glob("die_id=*")) and len(folders) == 600 + len(odd)
    for folder in folders:
        text = "".join(f.read_text() for f in sorted((tmp_path / "parts" / folder).glob("part-*")))
        assert [f.name for f in (tmp_path / "one" / folder).iterdir() if f.name[0] != "."] == ["labels.csv"]
        assert (tmp_path / "one" / folder / "labels.csv").read_text() == text.removesuffix("\n")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_labels(df, str(tmp_path / "one"), "made")
