"""Archives, decontamination and the pipeline."""

import hashlib
import math
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from moodspark.llm import decontaminate, warc
from moodspark.llm.queries import ORACLES, QUERIES

from .conftest import words


def test_loser_tree_merges():
    rng = random.Random(2)
    for k in range(12):
        runs = [sorted(rng.randrange(30) for _ in range(rng.randint(0, 9))) for _ in range(k)]
        merged = [e[1] for e in warc.LoserTree([iter([((v,), v) for v in run]) for run in runs])]
        assert merged == sorted(v for run in runs for v in run)


def captures(spark, rows):
    return spark.createDataFrame(rows, "id long, url string, micros long, payload string").repartition(3)


def test_archives_come_back_in_order(spark):
    big, small = "x" * 150, "y" * 20
    rows = [(i, f"http://www.Host{i % 3}.example:80/Path?{i % 5}", 1_000_000 * (i % 7), [big, small, None, "", f"é\r\n\r\nWARC/1.1 {i}" * 20][i % 5]) for i in range(60)]
    rows += [(100, None, None, big), (101, "http://[bad", 5, "z"), (102, "http://a b/\n", 5, "z")]
    got = warc.merge_runs(warc.materialise(warc.read_archives(warc.write_archives(warc.with_targets(captures(spark, rows)), folder := warc.scratch(spark, "t")), folder, run_rows=7), "r"), range_rows=9).collect()
    got.sort(key=lambda r: (r.range, r.place))
    assert [(r.url_key, r.micros, r.id) for r in got] == sorted((r.url_key, r.micros, r.id) for r in got)
    assert len({r.range for r in got}) > 3 and len(got) == len(rows)
    payloads = {r[0]: (r[3] or "").encode() for r in rows}
    for r in got:
        data = payloads[r.id]
        first = min(i for i, p in payloads.items() if p == data)
        revisit = len(data) >= 100 and first != r.id
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", first) if revisit else ("response", None))


def test_archives_keep_any_id_and_time(spark, tmp_path):
    text = "same page " * 20
    other = "other page " * 20
    ids = [2**62, -1, 253402300800, -(2**63), 2**63 - 1, 7, 7, 7]
    rows = [(i, "http://a", t, p) for i, t, p in zip(ids, [2**62, -(2**62), 5, -1, None, 1_500_000, 0, 0], [text, text, text, "tiny", text, other, text, other], strict=True)]
    got = sorted((r.id, r.record_type, r.refers_to, r.micros) for r in warc.capture_histories(captures(spark, rows)).collect())
    assert [g for g in got if g[0] != 7] == [
        (-(2**63), "response", None, -1), (-1, "response", None, warc.EARLIEST), (253402300800, "revisit", -1, 5), (2**62, "revisit", -1, warc.LATEST), (2**63 - 1, "revisit", -1, 0),
    ]
    assert [g for g in got if g[0] == 7] == [(7, "response", None, 0), (7, "response", None, 1_500_000), (7, "revisit", -1, 0)]
    assert warc.stamp(warc.EARLIEST) == "0001-01-01T00:00:00Z" and warc.moment_of(warc.stamp(-1)) == -1
    huge = "long page " * 300_000
    pages = spark.createDataFrame([(i, None, t) for i, t in zip(ids[:5], [huge, text, None, huge, text], strict=True)], "page_id long, url string, html string")
    pages.withColumn("micros", F.lit("extra")).write.parquet(f"{tmp_path}/pages.parquet")
    found = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.op1_warc_merge(spark, str(tmp_path)).collect()}
    assert found == {2**62: (len(huge), "revisit", -(2**63)), -1: (len(text), "response", None), 253402300800: (0, "response", None), -(2**63): (len(huge), "response", None), 2**63 - 1: (len(text), "revisit", -1)}


def test_no_captures(spark):
    assert warc.capture_histories(captures(spark, []).where("false")).count() == 0


def test_url_keys():
    assert warc.url_key("https://www.Example.com:443/A?b=C") == "com,example)/a?b=c"
    assert warc.url_key("http://u@a.b:81") == "b,a:81)/"


def test_block_max_wand_retrieves_all():
    rng = random.Random(6)
    items = [(i, " ".join(words(rng.random(), rng.randint(3, 40), 120))) for i in range(90)] + [(91, None or ""), (92, "!!")]
    index = decontaminate.Index(items, 0.4)
    for _ in range(300):
        terms = sorted({rng.randrange(len(index.vocabulary)) for _ in range(rng.randint(1, 60))})
        expected = {}
        for t in terms:
            for i in range(index.start[t], index.start[t + 1]):
                expected[index.items[i]] = expected.get(index.items[i], 0) + index.impacts[i]
        assert [i for i, _ in index.retrieve(terms)] == sorted(i for i, v in expected.items() if v >= 0.4 - 1e-9)


def test_windows_skip_no_match():
    rng = random.Random(8)
    items = [(i, " ".join(words(rng.random(), rng.randint(12, 60), 900))) for i in range(50)]
    index = decontaminate.Index(items, 0.6)
    for _ in range(60):
        key, text = rng.choice(items)
        body = words(rng.random(), rng.randint(0, 700), 900)
        at = rng.randint(0, len(body))
        found = index.search(" ".join([*body[:at], text.upper(), *body[at:]]))
        assert (key, 1.0, 1.0) in [(k, q, a) for k, _, q, a in found]


def plain_bm25(items, text, threshold):
    """Scores and overlaps of each item in a text that is one passage, straight from the formulas."""
    given = {k: re.findall("[a-z0-9]+", t.lower()) for k, t in items if t}
    given = {k: w for k, w in given.items() if w}
    n, mean = len(given), sum(map(len, given.values())) / len(given)
    spread = Counter(w for words in given.values() for w in set(words))
    passage = re.findall("[a-z0-9]+", text.lower())
    out = {}
    for key, own in given.items():
        mass = {w: math.log(1 + (n - spread[w] + 0.5) / (spread[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own) / mean)) for w, tf in Counter(own).items()}
        score = sum(v for w, v in mass.items() if w in set(passage)) / sum(mass.values())
        size = min(5, len(own))
        there = {tuple(passage[i : i + size]) for i in range(len(passage) - size + 1)}
        covered = [any(tuple(own[i : i + size]) in there for i in range(max(0, p - size + 1), min(p, len(own) - size) + 1)) for p in range(len(own))]
        cut = -(-2 * len(own) // 3)
        question = sum(covered[:cut]) / cut
        if score >= threshold - 1e-9:
            out[key] = (score, question, sum(covered[cut:]) / (len(own) - cut) if cut < len(own) else question)
    return out


def test_search_matches_plain_bm25():
    rng = random.Random(16)
    items = [(i, " ".join(words(rng.random(), rng.randint(1, 50), 300))) for i in range(60)] + [(61, None or ""), (62, "!!")]
    index = decontaminate.Index(items, 0.3)
    for _ in range(150):
        own = rng.choice(items[:60])[1].split()
        at = rng.randrange(len(own))
        passage = " ".join([*words(rng.random(), rng.randint(0, 10), 300), *own[at:], *words(rng.random(), rng.randint(0, 8), 300), *own[:at]][:64])
        got = {k: v for k, *v in index.search(passage)}
        expected = plain_bm25(items, passage, 0.3)
        assert sorted(got) == sorted(expected)
        assert all(got[k] == pytest.approx(expected[k]) for k in got)


@pytest.mark.parametrize(("share", "least"), [(0.0, 1.0), (0.05, 0.97), (0.1, 0.9)])
def test_edited_items_are_found(share, least):
    """Recall of items of which a share of the words was changed at random, in running text."""
    rng = random.Random(21)
    items = [(i, " ".join(words(rng.random(), rng.randint(24, 60), 900))) for i in range(400)]
    index = decontaminate.Index(items, 0.6)
    found = 0
    for key, text in items:
        own = text.split()
        for p in rng.sample(range(len(own)), round(share * len(own))):
            own[p] = f"e{rng.randrange(900)}"
        around = words(rng.random(), 300, 900)
        hits = {k: min(q, a) for k, _, q, a in index.search(" ".join([*around[:150], *own, *around[150:]]))}
        found += hits.get(key, 0) >= 0.5
    assert found >= least * len(items)
    quiet = [k for i in range(200) for k, _, q, a in index.search(" ".join(words(1000 + i, 400, 900))) if min(q, a) >= 0.5]
    assert quiet == []


def test_parts_share_statistics(documents, spark):
    rng = random.Random(31)
    rows = [(i, " ".join(words(rng.random(), rng.randint(3, 50), 300))) for i in range(80)]
    items = spark.createDataFrame([*rows, (None, "x y")], "item_id long, text string")
    docs = documents([" ".join([*words(rng.random(), 40, 300), *rng.choice(rows)[1].split(), *words(rng.random(), 90, 300)]) for _ in range(40)])
    whole, dealt = (sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in decontaminate.find_leaks(docs, items, threshold=0.4, verified=False, part_bytes=n).collect()) for n in (1 << 24, 12_000))
    assert whole == dealt and len(whole) >= 40


def test_leak_query(spark, tmp_path):
    leak, long = " ".join(words(4, 40)), " ".join(words(5, 5000, 3000))
    spark.createDataFrame([(1, f"x {leak} y", 3), (2, None, 3), (2, leak, 3), (None, leak, 3), (3, f"z {long}", 3)], "doc_id long, text string, item_id int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, leak, 1), (10, leak, 1), (11, long, 1), (12, None, 1), (13, "", 1)], "item_id long, text string, doc_id int").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(((r.doc_id, r.item_id) for r in decontaminate.op9_benchmark_bm25(spark, str(tmp_path)).collect()), key=str)
    assert got == [(1, 10), (2, 10), (3, 11), (None, 10)]


def test_leaks(documents, spark):
    items = spark.createDataFrame([(1, " ".join(words(1, 40))), (2, "tiny one"), (3, None), (2, "tiny one")], "item_id long, text string")
    item = " ".join(words(1, 40))
    docs = documents([f"before {item} after", item, item[: len(item) // 2], None, "", "a tiny one here", "one tiny", " ".join(words(9, 500))], extra=["1 AS item_id", "2 AS score"])
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect())
    assert got == [(0, 1), (1, 1), (5, 2)]
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items, part_bytes=64).collect()) == got
    kept = decontaminate.drop_leaking(docs, items)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6, 7] and kept.columns == docs.columns
    assert decontaminate.find_leaks(docs, items.where("false")).count() == 0
    assert decontaminate.find_leaks(documents([]), items).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    base = words(3, 120)
    near = list(base)
    near[60] = "changed"
    leak = " ".join(words(4, 30))
    texts = [" ".join(base), " ".join(near), f"some text {leak} goes on", "you stupid idiot moron, you worthless scum", "token=abcdef123456 is set", None, "", "calm words " * 3]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(99, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = sorted(r.doc_id for r in docs.collect())
    assert kept["toxicity"] == [0, 1, 2, 4, 5, 6, 7]
    assert kept["near_duplicates"] == [0, 2, 4, 5, 6, 7]
    assert kept["decontamination"] == kept["secrets"] == [0, 4, 5, 6, 7]
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in rows) == kept["secrets"] and all(r.decodes for r in rows)
    masked = {r.doc_id: r for r in docs.collect()}[4]
    assert masked.text == "[ASSIGN] is set" and masked.n_chars == len(masked.text)


@pytest.mark.parametrize("most", [0, 1000])
def test_pipeline_hard_rows(spark, tmp_path, hard_texts, monkeypatch, most):
    import corpus_pipeline

    monkeypatch.setattr(corpus_pipeline, "MOST_BROADCAST", most)
    texts = [t if t is None or len(t) < 50_000 else t[:50_000] for t in hard_texts]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "one"), (3, "one"), (0, None), (1, "later"), (None, "no id"), (None, "no id"), (5, texts[5])]
    frame = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    extra = {"component_id": F.lit(1), "n_rows": F.lit("x"), "token": F.lit(2.5), "score": F.lit(0), "item_id": F.lit(None).cast("int")}
    frame.repartition(3).withColumns(extra).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x")).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").withColumn("doc_id", F.lit(3)).write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert kept.columns == [*frame.columns, *extra]
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in out), key=str) == ids
    assert ids.count(None) == 2 and ids.count(1) == 2 and all(ids.count(i) == 1 for i in (0, 2, 3, 5)) and not {4, 6, 7, 8} & set(ids)
    assert all(r.decodes for r in out)
    spark.read.parquet(f"{tmp_path}/documents.parquet").where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        path = f"{DIR}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = QUERIES[name](spark, DIR)
    result = con.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(map(str, result.fetchall())) == sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
