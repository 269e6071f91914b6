import json
import struct
import zlib

import numpy as np
import pytest

from rollstats import cli
from rollstats.sources import sinks


def test_label_then_summarize_then_combine(spark, tmp_path, capsys):
    (tmp_path / "die").mkdir()
    names = [[f"{k:03}.jpg" for k in range(200) if k % 3 == g] for g in range(3)]
    (tmp_path / "die" / "summary.json").write_text(json.dumps(names))
    cli.main(["label", str(tmp_path / "die" / "summary.json"), str(tmp_path / "labels"), "1", "2", "4"])
    assert "no file has label 3" in capsys.readouterr().out
    cli.main(["summarize", str(tmp_path / "labels" / "*" / "labels.csv"), "--csv", str(tmp_path / "csv"), "--sequence-graph", str(tmp_path / "grey"), "--resamples", "50"])
    out = capsys.readouterr().out
    assert "N=200" in out and "fair=0.333" in out and out.count("o") >= 3
    assert spark.read.parquet(str(tmp_path / "grey")).count() == 16
    [csv] = (tmp_path / "csv").glob("*/*.csv")
    cli.main(["combine", str(csv), str(csv)])
    sums = [line.split(",") for line in capsys.readouterr().out.strip().split("\n")]
    assert [s[0] for s in sums] == ["2", "3", "4", "5", "6", "8"] and abs(sum(float(s[1]) for s in sums) - 1) < 1e-3


def png(path, image):
    """A small encoder of (height, width, 3) bytes."""
    h, w, _ = image.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + r.tobytes() for r in image)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def test_crop_skips_what_is_done(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    blank = np.zeros((180, 240, 3), dtype=np.uint8)
    png(tmp_path / "in" / "reference.jpg", blank)  # the decoder goes by contents
    photo = blank.copy()
    photo[30:90, 60:120] = 200
    png(tmp_path / "in" / "a.jpg", photo)
    png(tmp_path / "in" / "b.jpg", blank)
    command = ["crop", str(tmp_path / "in"), str(tmp_path / "out"), "--resize", "3", "--crop-size", "75"]
    cli.main(command)
    out = capsys.readouterr().out
    assert "processed: 1" in out and "not found: 1" in out and "not found in b.jpg @ threshold 180: no region" in out
    [r] = spark.read.parquet(str(tmp_path / "out")).where("not_found is null").collect()
    assert (r.file, r.x_min, r.y_min, r.x_max, r.y_max, r.crop_x.high - r.crop_x.low) == ("a.jpg", 60, 30, 117, 87, 75)
    cli.main(command)
    assert "skipped: 2" in capsys.readouterr().out


def test_group_by_pips_and_index(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    for name, n in (("a.png", 2), ("b.png", 1), ("c.png", 2)):
        face = np.full((60, 120, 3), 230, dtype=np.uint8)
        for k in range(n):
            face[10:40, 10 + 50 * k : 40 + 50 * k] = 20
        png(tmp_path / "in" / name, face)
    cli.main(["group", str(tmp_path / "in"), str(tmp_path / "out")])
    assert capsys.readouterr().out.splitlines() == ["2 pips: 2 files, first a.png", "1 pips: 1 files, first b.png"]
    (tmp_path / "h.csv").write_text("side,p,ci_low,ci_high\n1,0.5,0.4,0.6\n2,0.5,0.4,0.6\n")
    (tmp_path / "index.json").write_text(json.dumps({"c": {"title": "T", "filenames": ["h.csv"]}}))
    cli.main(["index", str(tmp_path / "index.json"), str(tmp_path / "h.csv"), str(tmp_path / "page.html"), "--title", "My <dice>"])
    page = (tmp_path / "page.html").read_text()
    assert "My &lt;dice&gt;" in page and sinks.report_data(page)["h"][1]["p"] == 0.5


def test_group_by_matches(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    names = [f"{k:02}.jpg" for k in range(20)]
    for n in names:
        (tmp_path / "in" / n).write_bytes(b"x")
    # Photos of one face match the first two of that face; 18 matches photo 2 only, and 19 photo 0 with another number of features: too weak at first.
    rows = [(n, names[o], 40 + k, 1.0, 100, 110) for k, n in enumerate(names[:18]) for o in (k % 2, k % 2 + 2) if o < k]
    rows += [("18.jpg", "02.jpg", 20, 1.0, 100, 110), ("19.jpg", "00.jpg", 99, 1.0, 100, 130)]
    schema = "item string, leader string, inliers int, scale double, features_a int, features_b int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "m"))
    cli.main(["group", str(tmp_path / "in"), str(tmp_path / "out"), "--matches", str(tmp_path / "m"), "--summary-max-members", "3"])
    assert capsys.readouterr().out.splitlines()[:2] == ["9 files, first 00.jpg", "9 files, first 01.jpg"]
    lists = json.loads((tmp_path / "out" / "die_id=summary" / "summary.json").read_text())
    assert lists == [names[0:18:2], names[1:18:2], ["18.jpg"], ["19.jpg"]]
    assert spark.read.parquet(str(tmp_path / "out" / "tiles")).count() == 8
    cli.main(["group", str(tmp_path / "in"), str(tmp_path / "out2"), "--matches", str(tmp_path / "m"), "-m", "20", "--feature-threshold", "1.4"])
    assert json.loads((tmp_path / "out2" / "die_id=summary" / "summary.json").read_text()) == [[*names[0:18:2], "18.jpg", "19.jpg"], names[1:18:2]]


def test_label_shows_members_when_numbers_differ(spark, tmp_path, capsys):
    (tmp_path / "die").mkdir()
    (tmp_path / "die" / "summary.json").write_text(json.dumps([[f"{k}.jpg" for k in range(9)], ["x.jpg"]]))
    with pytest.raises(SystemExit, match="2 groups but 1 labels"):
        cli.main(["label", str(tmp_path / "die" / "summary.json"), str(tmp_path / "labels"), "7"])
    assert capsys.readouterr().out.splitlines() == ["7: 0.jpg 1.jpg 2.jpg 3.jpg", "-: x.jpg"]


def test_what_a_page_leaves_unfilled():
    assert sinks.unfilled("<p>costs $name</p><script>a = '$x'</script><b>fine</b>\n$") == ["costs $name", "$"]
