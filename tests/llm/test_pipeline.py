"""Decontamination, URL filtering and the pipeline."""

import glob
import hashlib
import os
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rollstats.llm import decontaminate, language, packing, registry, reputation, simhash
from test_contracts import components, plain_fingerprint, plain_pii, similarity

ITEM = "The train from Paris leaves at 7 o'clock and travels 120 km in 2 hours, how far does it go in 5 hours"


def held(spark, stored, texts, items):
    docs = stored(spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "k int, text string, size int"))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {r.text_key: r.item for r in decontaminate.contaminated(docs, bench).collect()}
    return [found.get(r[0]) for r in docs.orderBy("k").select(decontaminate.text_key(F.col("text"))).collect()]


def test_templates(spark, stored):
    texts = [
        f"Before it. {ITEM}. After it.", None, "", "The train from Paris was late and nobody minded that much at all today",
        "The train from London leaves at 9 o'clock and travels 300 km in 4 hours, how far does it go in 6 hours?",
        " ".join(ITEM.split()[:11]) + " but then stops for good", ITEM, ITEM.upper(),
        f"so then {ITEM.lower()} and on it goes", "THE TRAIN FROM PARIS WAS LATE AND NOBODY MINDED THAT MUCH AT ALL TODAY",
    ]
    got = held(spark, stored, texts, ["short one", ITEM, None, ""])
    assert got == [1, None, None, None, 1, None, 1, 1, 1, None]


def test_inconsistent_slots_are_no_copy(spark, stored):
    item = "take 3 add 4 take 3 add 4 take 3 add 4 take 3 add 4"
    assert held(spark, stored, [item.replace("3", "8").replace("4", "5"), "take 1 add 2 take 3 add 4 take 5 add 6 take 7 add 8"], [item]) == [0, None]


def test_slots_are_checked_copy_by_copy(spark, stored):
    item = "take 3 add 4 then take 3 add 4 then take 3 add 4 then take 3 add 4"
    other = item.replace("3", "8").replace("4", "5")
    third = item.replace("3", "7").replace("4", "9")
    run = ", ".join(map(str, range(1, 13)))
    texts = [f"{item}. Some words. {other}", f"{third} or else {other}", f"see {run} here", "take 1 add 2 then take 3 add 4 then take 5 add 6 then take 7 add 8"]
    assert held(spark, stored, texts, [item, run]) == [0, 0, 1, None]


def test_changed_words_and_passages_are_found(spark, stored):
    words = [f"w{'abcdefghijklmnopqrstuvwxyz'[k // 26]}{'abcdefghijklmnopqrstuvwxyz'[k % 26]}" for k in range(150)]
    items = [words[:15], words[20:42], words[50:109], words[110:121]]
    changed = lambda x, k: " ".join([*x[:k], "changed", *x[k + 1 :]])
    added = lambda x, k: " ".join([*x[:k], "added", *x[k:]])
    texts = [f(x, len(x) // 2) for x in (items[0], items[1], items[3]) for f in (changed, added)]
    texts += [f"before {' '.join(items[2][9:38])} after", " ".join(items[2][9:21]), " ".join(items[0][:7]), "1 2 3 4 5 6 7 8 9 10 11 12 13"]
    numbers = " ".join(map(str, range(100, 130)))
    want = [0, 0, 1, 1, 3, 3, 2, None, None, None]
    assert held(spark, stored, texts, [" ".join(x) for x in items] + [numbers]) == want


def test_short_items_are_matched_whole(spark, stored):
    texts = ["well, who wrote the moby dick novel then", "who wrote the other one", "He asked Who wrote the moby dick novel again", "so Alpha, beta! it is", "alpha and beta", "it is 42 now", "it is 43 now"]
    assert held(spark, stored, texts, ["Who wrote the moby dick novel", "alpha beta", "42", ""]) == [0, None, 0, 1, None, 2, None]


def test_slots_of_every_item_are_checked(spark, stored):
    item = "A farmer keeps 12 hens and 12 ducks near the old mill and sells the eggs in town"
    texts = [item, item.replace("12", "30"), item.replace("12 hens", "9 hens"), item.replace("12 hens", "9 hens").replace("12 ducks", "7 ducks")]
    assert held(spark, stored, texts, [item]) == [0, 0, None, None]


def plain_templates(text, item):
    """Coverage of the item's template windows by the text, over consistent whole alignments, word by word."""
    cut = lambda t: [m.group(0) for m in re.finditer(r"[a-z]+|[0-9]+", t)]
    a, b = cut(text), cut(item)
    best = 0.0
    for shift in range(-len(b) + 1, len(a)):
        same = [0 <= shift + k < len(a) and (a[shift + k] == b[k] or a[shift + k].isdigit() and b[k].isdigit()) for k in range(len(b))]
        size = 5 if 8 < len(b) < 24 else min(8, len(b))
        at = sorted({w for k in range(len(b) - size + 1) if all(same[k : k + size]) for w in range(k, k + size)})
        pairs = {(b[k], a[shift + k]) for k in at if b[k].isdigit()}
        if len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs}):
            best = max(best, len(at) / len(b))
    return best


def test_templates_against_brute_force(spark, stored):
    rng = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnr"]
    items = [" ".join(rng.choice(words) if rng.random() < 0.8 else str(rng.randrange(10, 60)) for _ in range(rng.choice((12, 16, 20, 30)))) for _ in range(12)]
    texts = []
    for k in range(160):
        w = rng.choice(items).split()
        cut = w[: rng.choice((len(w), len(w) // 2, len(w) // 3))]
        values = {x: str(rng.randrange(100, 999)) for x in cut if x.isdigit()}
        how = rng.random()
        cut = [x if not x.isdigit() else values[x] if how < 0.4 else x if how < 0.7 else str(rng.randrange(100, 999)) for x in cut]
        pad = lambda: [rng.choice(words) for _ in range(rng.randrange(12))]
        texts.append(" ".join([*pad(), *cut, *pad()]))
    docs = stored(spark.createDataFrame([(t,) for t in texts], "text string"))
    found = {(r.text_key, r.item) for r in decontaminate.contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    hit = 0
    for t in texts:
        key = hashlib.md5(t.encode()).hexdigest()
        for k, item in enumerate(items):
            x = plain_templates(t, item)
            if x >= 0.65:
                assert (key, k) in found, (t, item)
                hit += 1
            elif x < 0.3:
                assert (key, k) not in found, (t, item)
    assert hit > 40


def test_clean_of_does_not_depend_on_the_parallelism(spark, tmp_path):
    sf, key = "/root/testdata/sf0.01", "spark.sql.leafNodeDefaultParallelism"
    spark.read.parquet(f"{sf}/documents.parquet").repartition(12).write.parquet(f"{tmp_path}/d")
    results = []
    for later in ("2", "48"):
        spark.conf.set(key, "2")
        out = decontaminate.clean_of(spark.read.parquet(f"{tmp_path}/d"), spark.read.parquet(f"{sf}/benchmark.parquet"))
        spark.conf.set(key, later)
        results.append(sorted(r.doc_id for r in out.collect()))
    spark.conf.unset(key)
    assert results[0] == results[1] and len(results[0]) < 1000


def test_no_items_or_no_documents(spark, stored):
    assert held(spark, stored, ["some words that are here and there again"], []) == [None]
    assert held(spark, stored, [], [ITEM]) == []


def test_op7_finds_whole_passages(spark):
    sf = "/root/testdata/sf0.01"
    items = {r.item_id: " ".join(re.findall(r"\w+", r.text.lower())) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs = {r.doc_id: " ".join(re.findall(r"\w+", r.text.lower())) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {d: ",".join(map(str, sorted(i for i, t in items.items() if t in x))) for d, x in docs.items()}
    got = {r.doc_id: r.items for r in registry.queries()["op7_decontaminate"](spark, sf).collect()}
    assert got == want and sum(bool(x) for x in want.values()) > 3


def test_reputation_shrinks(spark):
    pages = spark.createDataFrame(
        [(k, f"http://bad.spam.com/{k}") for k in range(40)] + [(100 + k, f"http://www.good.com/{k}") for k in range(40)]
        + [(200, "http://new.spam.com/x"), (201, "HTTP://WWW.GOOD.COM/A?b#c"), (202, None), (203, "no host"), (None, "http://x.net/"), (205, "http://a.example.net/en/1"), (205, "http://a.example.net/en/1"), (206, "http://net")],
        "page_id long, url string",
    )
    outcomes = spark.createDataFrame([(k, 1) for k in range(40)] + [(100 + k, 0) for k in range(40)] + [(101, 0), (None, 1), (9999, 1)], "page_id long, bad int")
    out = reputation.judge_urls(pages, outcomes).collect()
    assert len(out) == pages.count()
    by = {r.page_id: r for r in out}
    assert by[0].verdict == "block" and by[0].rule is None and by[100].verdict == "allow"
    assert by[200].reputation > 0.5 > by[201].reputation and by[201].host == "www.good.com" and by[201].path == "/A"
    assert by[202].host == by[202].path == by[203].host == "" and by[None].rule == "net/" and by[None].verdict == "block"
    assert by[205].rule == "example.net/en/" and by[205].verdict == "allow" and by[206].rule is None
    none = reputation.judge_urls(pages, outcomes.limit(0)).collect()
    assert {r.reputation for r in none} == {0.5} and len(none) == len(out)
    assert reputation.judge_urls(pages.limit(0), outcomes).collect() == []


def test_reputation_blocks_planted_hosts_among_the_given(spark):
    """Pages of a bad host and of one as good as the rest, in the given table: precision and recall of the method's blocks."""
    sf = "/root/testdata/sf0.1"
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    urls = [(10**6 + 1000 * h + k, f"http://h{h}.{'farm' if h < 5 else 'fine'}{h}.com/{k}") for h in range(10) for k in range(200)]
    outcomes = [(i, int(k % 10 < 9) if i < 10**6 + 5000 else int(k % 10 < 2)) for k, (i, _) in enumerate(urls)]
    out = reputation.judge_urls(pages.union(spark.createDataFrame(urls, pages.schema)), labels.union(spark.createDataFrame(outcomes, "page_id long, bad int"))).where("rule is null")
    planted = {r.host: r.verdict for r in out.where(F.col("page_id") >= 10**6).select("host", "verdict").distinct().collect()}
    assert [planted[f"h{h}.{'farm' if h < 5 else 'fine'}{h}.com"] for h in range(10)] == ["block"] * 5 + ["allow"] * 5
    given = out.where(F.col("page_id") < 10**6)
    assert given.where("verdict = 'block'").count() <= 0.1 * given.count()


def test_domains_and_suffixes(spark):
    hosts = ["news.bbc.co.uk", "10.0.0.7", "a.com:8080", "www.a.com", "com", "", "x.co.uk", "[::1]:80", "1.2.3.4:5"]
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", reputation.domain(F.col("h")), reputation.suffix(F.col("h"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {
        "news.bbc.co.uk": ("bbc.co.uk", "co.uk"), "10.0.0.7": ("10.0.0.7", "10.0.0.7"), "a.com:8080": ("a.com", "com"), "www.a.com": ("a.com", "com"),
        "com": ("com", "com"), "": ("", ""), "x.co.uk": ("x.co.uk", "co.uk"), "[::1]:80": ("[::1]", "[::1]"), "1.2.3.4:5": ("1.2.3.4", "1.2.3.4"),
    }


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = registry.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_pipeline_stages(spark, stored):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(90_000, "12345 !!!", None, None, 9), (90_001, None, "en", "s", 0), (90_002, "mail a.b@c.example.com now please", "en", "s", 33)]
    at = stored(docs.unionByName(spark.createDataFrame(odd, docs.schema)))
    sizes = [at.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, sf)
        assert out.columns == docs.columns, name
        at = stored(out)
        sizes.append(at.count())
    texts = {r.doc_id: r.text for r in at.collect()}
    assert 90_000 not in texts and 90_001 not in texts and texts[90_002] == "mail <EMAIL> now please"
    assert sizes[1] == sizes[0] - 2 and sizes[2] < sizes[1] and sizes[3] < sizes[2] and sizes[4] == sizes[3]
    assert at.where(F.length("text") != F.col("n_chars")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, at, sf)
    assert packed.select("doc_id").distinct().count() == sizes[4]


def test_clashing_columns_stay(spark, stored):
    sf = "/root/testdata/sf0.001"
    names = ["_row", "row", "_judged", "_rules", "_loose", "lang_pred", "lang_score", "pii_rules", "pii_spans", "_email_1", "_hashes", "fp", "a.b"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at = stored(docs.select("*", *(F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in names)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, sf)
        assert out.columns == docs.columns + names, name
        at = stored(out)
    rows = at.collect()
    assert rows and all(r[n] == f"{n}:{r.doc_id}" for r in rows for n in names)


def test_run_on_an_empty_table(spark, stored, tmp_path):
    sf = "/root/testdata/sf0.001"
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def plain_redacted(text):
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in plain_pii(text)):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_run_against_brute_force(spark):
    """Every stage in plain Python over the smallest tables: the same documents, texts and ids at the end."""
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    labels, scores = language.predict(language.train(docs), list(rows.values()))
    rows = {i: t for (i, t), label, score in zip(rows.items(), labels, scores) if label != "und" and score >= corpus_pipeline.MIN_LANGUAGE_SCORE}
    narrow = {i: plain_fingerprint(t) for i, t in rows.items()}
    wide = {i: int.from_bytes(simhash.wide_fingerprint(t), "little") for i, t in rows.items()}

    def close(a, b):
        """As documented: two bits, or the wide limit; so few rows are all compared."""
        return (narrow[a] ^ narrow[b]).bit_count() <= 2 or (wide[a] ^ wide[b]).bit_count() <= simhash.MAX_WIDE

    ids = sorted(rows)
    group = components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if close(a, b)])
    rows = {i: t for i, t in rows.items() if group[i] == i}
    left = sorted(rows)
    assert not [(a, b) for k, a in enumerate(left) for b in left[k + 1 :] if (wide[a] ^ wide[b]).bit_count() < 70 and similarity(rows[a], rows[b]) >= 0.8]
    words = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {i: plain_redacted(t) for i, t in rows.items() if not any(x in words(t) for x in items)}
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in rows.items()}
    pieces, windows = {}, {}
    for r in corpus_pipeline.run(spark, sf).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(want) and len(want) < docs.count()
    for i, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            ids = want[i][r.start : r.start + r.length]
            assert r.start == at and r.doc_tokens == len(want[i]) and zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)) == r.ids_crc32
            at += r.length
        assert at == len(want[i])
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
