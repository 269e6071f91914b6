"""Texts of very many matches and pages of very many lines: linear time, and the results of plain loops."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from rollstats.llm import decontaminate, htmlmain, pii


@pytest.mark.parametrize("fold, block", [(256, 512), (3, 5)])
def test_places_of_matches(spark, monkeypatch, fold, block):
    monkeypatch.setattr(pii, "FOLD", fold)
    monkeypatch.setattr(pii, "BLOCK", block)
    rng = random.Random(1)
    texts = ["", "1", "x", "1x22", *("".join(rng.choice("12aé😀 \n") for _ in range(rng.randint(0, 90))) for _ in range(60))]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select("text", pii.located(F.col("text"), "[0-9]+").alias("m"), pii.blocks(F.col("text")).alias("b")).collect()
    for r in got:
        assert [(x.start, x.end, x.m) for x in r.m] == [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", r.text)]
        assert "".join(r.b) == r.text and all(len(b) == block for b in r.b[:-1])
    cuts = spark.createDataFrame([(t, a, n) for t in texts for a in (0, 1, 4, 5, 17) for n in (0, 1, 5, 30)], "text string, a int, n int")
    for r in cuts.select("*", pii.part(pii.blocks(F.col("text")), F.col("a"), F.col("n")).alias("got")).collect():
        assert r.got == r.text[r.a : r.a + r.n]


def spans_of(rng, size):
    out = []
    for _ in range(rng.randint(0, 12)):
        start = rng.randint(0, size)
        out.append((rng.randint(0, 3), start, min(size, start + rng.randint(1, 9)), rng.choice(["ip", "card"])))
    return [s for s in out if s[1] < s[2]]


@pytest.mark.parametrize("fold, block", [(256, 512), (2, 3)])
def test_redaction_and_overlaps_against_loops(spark, monkeypatch, fold, block):
    monkeypatch.setattr(pii, "FOLD", fold)
    monkeypatch.setattr(pii, "BLOCK", block)
    rng = random.Random(2)
    rows = []
    for _ in range(150):
        text = "".join(rng.choice("abcdé😀 ") for _ in range(rng.randint(0, 60)))
        rows.append((text, spans_of(rng, len(text)), spans_of(rng, len(text))))
    span = "array<struct<rank:int,start:int,end:int,kind:string>>"
    df = spark.createDataFrame(rows + [(None, [], [])], f"text string, spans {span}, other {span}")
    for r in df.select("*", pii.redacted(F.col("text"), F.col("spans")).alias("red"), pii.clear_of(F.col("other"), F.col("spans")).alias("clear")).collect():
        if r.text is None:
            assert r.red is None
            continue
        at, want = 0, ""
        for s, e, k in sorted((x.start, x.end, x.kind) for x in r.spans):
            if s >= at:
                want += r.text[at:s] + f"<{k.upper()}>"
            at = max(at, e)
        assert r.red == want + r.text[at:]
        free = [x for x in r.other if not any(y.start < x.end and x.start < y.end for y in r.spans)]
        assert sorted(r.clear) == sorted(free)


@pytest.mark.parametrize("unit", ["12,", "1.2.3.4 ", "0641 917 441, ", "a@b.co "])
def test_a_text_of_very_many_matches(spark, unit):
    n = 200_000
    began = time.time()
    df = spark.createDataFrame([(1, unit * n), (2, "mail a@b.co now")], "doc_id long, text string")
    found = pii.find_pii(df)
    out = found.select("doc_id", F.size("pii_rules").alias("rules"), F.size("pii_spans").alias("spans"), pii.redacted(F.col("text"), F.col("pii_spans")).alias("red")).collect()
    rows = {r.doc_id: r for r in out}
    assert time.time() - began < 60
    mark = {"1.2.3.4 ": "<IP> ", "a@b.co ": "<EMAIL> "}.get(unit)
    if mark:
        assert rows[1].rules == n and rows[1].red == mark * n
    assert rows[1].spans >= rows[1].rules and rows[2].rules == 1


def test_a_page_of_very_many_lines(spark):
    n = 200_000
    shared = [f"<p>menu entry {k}</p>" for k in range(n * 4 // 5)]
    pages = [(k, f"http://h.example.com/{k}", "<div>" + "".join(shared) + "".join(f"<p>own line {k} {j}</p>" for j in range(n // 5)) + "</div>") for k in range(2)]
    began = time.time()
    out = {r.page_id: r.text for r in htmlmain.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert time.time() - began < 60
    assert out == {k: "\n".join(f"own line {k} {j}" for j in range(n // 5)) for k in range(2)}


def test_lists_of_numbers(spark):
    """An item of 60 numbers and one of 40 rows of a template, and texts of up to 200,000 numbers."""
    rng = random.Random(4)
    numbers = [str(rng.randrange(1000, 9999)) for _ in range(60)]
    rows = [f"{x} of them cost {y} in all" for x, y in zip(rng.sample(range(100, 999), 40), rng.sample(range(1000, 9999), 40))]
    bench = spark.createDataFrame([(1, " ".join(numbers)), (2, ". ".join(rows))], "item_id long, text string")
    other = lambda n: " ".join(str(rng.randrange(10000, 99999)) for _ in range(n))
    texts = {
        "long": other(200_000), "middle": f"{other(3000)} {' '.join(numbers)} {other(3000)}", "half": f"{other(500)} {' '.join(numbers[9:45])} {other(500)}",
        "few": " ".join(numbers[:7]), "none": "no numbers here at all, and nothing else that is known",
        "rows": ". ".join(f"{k} of them cost {k + 5000} in all" for k in range(100, 140)), "copy": f"{other(900)} {'. '.join(rows)} {other(900)}",
        "many rows": ". ".join(f"{k} of them cost {k + 50_000} in all" for k in range(10_000)), "equal": "7 of them cost 7 in all. " * 5000,
    }
    docs = spark.createDataFrame(list(texts.items()), "name string, text string").repartition(4)
    at = time.monotonic()
    found = decontaminate.contaminated(docs, bench).withColumnRenamed("text_key", "key")
    named = docs.select("name", decontaminate.text_key(F.col("text")).alias("key"))
    got = {(r.name, r.item) for r in named.join(found, "key").collect()}
    assert time.monotonic() - at < 60
    assert got == {("middle", 1), ("half", 1), ("rows", 2), ("copy", 2), ("many rows", 2)}


def test_chains_against_a_plain_loop(spark):
    rng = random.Random(9)
    rows = [(t, h, at) for t in range(20) for h in range(3) for at in sorted(rng.sample(range(600), rng.randint(0, 40)))]
    got = decontaminate.chained(spark.createDataFrame(rows, "row int, hash int, at int"), ["row", "hash"], "at").collect()
    want = []
    for t in range(20):
        for h in range(3):
            chains = []
            for _, _, at in (r for r in rows if r[:2] == (t, h)):
                if not chains or at - chains[-1][-1] > decontaminate.CHAIN_GAP:
                    chains.append([])
                chains[-1].append(at)
            want += [(t, h, at, k + 1, len(c) - k) for c in chains for k, at in enumerate(c)]
    assert sorted((r.row, r.hash, r.at, r.first, r.last) for r in got) == sorted(want)
