"""Every query on odd tables: nulls in any column, repeated rows, columns that clash, and tables without rows."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rollstats.llm import registry

#: Names that operators use inside.
CLASHING = (
    "row _row rows n host path u rest part fp wide mask pattern node component component_id spans tokens pair is_doc kind rank start end"
    " sequence_id offset bucket hash item place at shift segment head body seen s parts label score bad mean low dim block doc _id"
).split()
LONG = "word " * 30_000
TABLES = {
    "documents": ("doc_id long, text string, lang string, source string, n_chars long", [
        (1, "mail a.b@c.example.com now please", "en", "s", 33), (1, "mail a.b@c.example.com now please", "en", "s", 33), (2, None, "en", None, None),
        (3, "", None, "s", 0), (None, "no id but a text of some words", "fr", "s", 1), (None, None, None, None, None), (4, LONG, "en", "s", len(LONG)),
    ]),
    "embeddings": ("vec_id long, embedding array<float>, label int", [
        (1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.1], None), (3, None, 1), (4, [0.0, 0.0], 1), (5, [None, 1.0], 1),
        (6, [float("nan"), 1.0], 1), (7, [float("inf"), 1.0], 1), (None, [0.0, 1.0], 1), (8, [], 1),
    ]),
    "pages": ("page_id long, url string, html string", [
        (1, "http://a.example.com/x", "<p>one</p><p>shared</p>"), (1, "http://a.example.com/x", "<p>one</p><p>shared</p>"), (2, "http://a.example.com/y", "<p>two</p><p>shared</p>"),
        (3, None, "<article>kept &amp; whole</article>"), (4, "http://b.example.net/", None), (None, "no host", ""), (5, "x://A.net", f"<article>{LONG}</article>"),
    ]),
    "benchmark": ("item_id long, text string", [(1, "mail a.b@c.example.com now please"), (1, "mail a.b@c.example.com now please"), (2, None), (None, "no id but a text of some words"), (3, "")]),
    "labels": ("doc_id long, quality int, toxic int", [(1, 0, None), (1, 0, None), (2, None, None), (None, 1, 1)]),
    "conversations": ("conv_id long, turn long, role string, text string", [
        (1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, None, None), (None, 1, "assistant", "x"), (2, 1, "assistant", ""), (3, 1, "assistant", LONG),
    ]),
}
#: The table whose rows a query returns once each.
OF = {1: "pages", 2: "embeddings", 3: "documents", 4: "documents", 7: "documents", 8: "documents", 9: "documents", 10: "pages"}


def tables(spark, folder, rows=True):
    for name, (schema, data) in TABLES.items():
        df = spark.createDataFrame(data if rows else [], schema).repartition(2)
        for c in CLASHING:
            if c not in df.columns:
                df = df.withColumn(c, F.lit("x"))
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("odd"))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("empty"), rows=False)


def number(name):
    return int(name[2:].split("_")[0])


@pytest.mark.parametrize("name", sorted(registry.queries(), key=number))
def test_odd_rows(spark, odd, name):
    got = registry.queries()[name](spark, odd).collect()
    if number(name) in OF:
        schema, data = TABLES[OF[number(name)]]
        ids = sorted((r[0] for r in data), key=str)
        assert sorted((r[0] for r in got), key=str) == ids
    none = hashlib.sha256(b"").hexdigest()
    if name.startswith("op1_"):
        texts = {r.page_id: r.text for r in got}
        assert texts[3] == "kept & whole" and texts[4] == "" and texts[None] == "" and texts[5] == LONG.strip()
        assert texts[2] == "two"
    if name.startswith("op2_"):
        rows = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
        assert rows[1] == (2, 1, True) and rows[2] == (2, 1, False) and rows[None] == (0, None, False)
        assert all(rows[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8))
    if name.startswith(("op3_", "op4_")):
        assert all(r.base_sha256 == none and r.spans == "" for r in got if r.doc_id in (2, 3, 4))
    if name.startswith("op5_"):
        ends = {(r.doc_id, r.doc_tokens) for r in got}
        assert {(2, 1), (3, 1), (None, 1)} <= ends and sum(r.length for r in got if r.doc_id == 4) == max(n for d, n in ends if d == 4)
    if name.startswith("op6_"):
        turns = {r.conv_id: (r.n_turns, r.loss_chars) for r in got}
        assert turns == {-1: (2, 34), 1: (3, 0), None: (1, 1), 2: (1, 0), 3: (1, len(LONG))}
    if name.startswith("op7_"):
        assert sorted((r.doc_id, r["items"]) for r in got if r.contaminated) == [(1, "1"), (1, "1")]
    if name.startswith("op8_"):
        assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (2, 3))
    if name.startswith("op9_"):
        assert all(r.fingerprint == "0" * 16 and r.component_id == 2 for r in got if r.doc_id in (2, 3))
    if name.startswith("op10_"):
        pages = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
        assert pages[3][:3] == pages[None][:3] == ("", "", None) and pages[4] == ("b.example.net", "/", "net/", "block")
        assert pages[5] == ("a.net", "", None, pages[5][3])
    if name.startswith("op11_"):
        assert got == []  # no id divisible by 100
    if name.startswith("op12_"):
        assert Counter(r.doc_id for r in got if r.doc_id != 4) == {1: 2, 2: 1, 3: 1, None: 2}
        assert sum(r.length for r in got if r.doc_id == 4) == 30_001 and max(r.piece for r in got) == 7
    if name.startswith("op13_"):
        pairs = sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in got)
        assert pairs == [(lang, a, "pair", b, 0, 1) for lang in ("", "en") for a, b in (("", "s"), ("s", ""))]


@pytest.mark.parametrize("name", sorted(registry.queries(), key=number))
def test_no_rows(spark, empty, name):
    got = registry.queries()[name](spark, empty).collect()
    assert [r.conv_id for r in got] == [-1] if name.startswith("op6_") else got == []


def test_pipeline_on_odd_rows(spark, odd, stored):
    columns = spark.read.parquet(f"{odd}/documents.parquet").columns
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd)
        assert out.columns == columns, name
        docs = stored(out)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, odd)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
