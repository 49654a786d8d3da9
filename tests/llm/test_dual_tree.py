"""Hard negatives against brute force."""

import math
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from moodspark.llm import dualtree
from moodspark.llm.queries import ORACLES

SMALL = "/root/testdata/sf0.001"


def plain(rows, is_anchor, scale=256, low=80, high=100, k=5):
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank) of (id, label, vector) rows."""
    kept = []
    for key, label, vector in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(scale * x) for x in vector]
        if all(abs(x) <= dualtree.LARGEST for x in whole):
            kept.append((key, label, whole))
    out = []
    for i, (anchor, own, a) in enumerate(kept):
        if not is_anchor(anchor):
            continue
        scored = [(-sum(x * y for x, y in zip(a, b, strict=False)), key, label) for j, (key, label, b) in enumerate(kept) if j != i]
        positives = sorted((s, key) for s, key, label in scored if label == own)[:k]
        for place, (score, positive) in enumerate(positives):
            fits = sorted((s, key) for s, key, label in scored if label != own and low * -score <= 100 * -s <= high * -score)[:k]
            out += [(anchor, positive, r + 1, key, -score, -s, place + 1) for r, (s, key) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, is_anchor, parts=4, **sizes):
    frame = spark.createDataFrame(rows, "id long, label long, vector array<double>").repartition(parts).withColumns({"cell": F.lit("own"), "part": F.lit(1)})
    got = dualtree.hard_negatives(frame, is_anchor, **sizes)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank"]
    return sorted(tuple(r) for r in got.collect())


def clouds(seed, n, dimensions, labels, middles=6):
    """Vectors about a few middles, on a coarse grid so that scores tie."""
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(middles, dimensions))
    return [(i, int(rng.integers(labels)), [float(x) for x in np.round(at[rng.integers(middles)] + 0.2 * rng.normal(size=dimensions), 1)]) for i in range(n)]


def test_many_cells_and_chunks(spark):
    rows = clouds(1, 700, 6, 3)
    got = mined(spark, rows, F.col("id") % 20 == 0, cell_rows=60, chunk_rows=40, group_rows=8)
    assert got == plain(rows, lambda i: i % 20 == 0) and len(got) > 300


def test_hard_rows(spark):
    rows = clouds(2, 150, 4, 2)
    rows += [(200, 0, None), (300, None, [1.0] * 4), (400, 0, [1.0, None, 1.0, 1.0]), (500, 0, [1.0, math.nan, 0.0, 0.0]), (600, 1, [math.inf, 0.0, 0.0, 0.0]), (700, 1, [1e30, 0.0, 0.0, 0.0]), (None, 0, [9.0] * 4)]
    rows += [(800, 0, []), (-900, 1, [2.0]), (1000, 0, [-3.0] * 4), (1100, 5, [1.0] * 4), (2**62, 1, [1.5] * 4), (-(2**63), 0, [1.5] * 4)]
    rows += [(100, 0, [1.0, 0.5, 0.0, 0.0])] * 3 + [(100, 1, [1.0, 0.5, 0.0, 0.0]), (100, 0, [0.0] * 4)]
    rows += [(1200, 1, [2.0, 1.0, 1.0, 0.0])] * 60 + [(1201, 0, [2.0, 1.0, 1.0, 0.0])] * 60
    anchors = lambda i: i % 100 == 0
    assert mined(spark, rows, F.col("id") % 100 == 0, cell_rows=50, chunk_rows=16, group_rows=8) == plain(rows, anchors)


def test_no_rows(spark):
    assert mined(spark, [], F.col("id") % 100 == 0) == []
    assert mined(spark, [(1, 1, [1.0])], F.col("id") % 100 == 0) == []
    assert mined(spark, [(0, 1, [1.0])], F.col("id") % 100 == 0) == []
    assert mined(spark, [(0, None, [1.0])], F.col("id") % 100 == 0) == []


def test_other_percentages(spark):
    rows = clouds(3, 200, 3, 4)
    got = mined(spark, rows, F.col("id") < 10, n_positives=3, n_negatives=3, low_percent=33, high_percent=120, cell_rows=50, chunk_rows=32)
    assert got == plain(rows, lambda i: i < 10, low=33, high=120, k=3)


def packed(rows, leaf):
    labels, ids = np.array([r[1] for r in rows], "<i8"), np.array([r[0] for r in rows], "<i8")
    whole = np.array([[math.floor(256 * x) for x in r[2]] for r in rows], "<i4")
    order = dualtree.tree_order(whole.astype(float), labels, leaf)
    return dualtree.Tree(len(rows), 4, ids[order].tobytes(), labels[order].tobytes(), whole[order].tobytes(), leaf)


def test_intervals_hold_and_prune(monkeypatch):
    a, b = packed(clouds(4, 60, 8, 2), 8), packed(clouds(4, 900, 8, 2, 12), 16)
    scores = a.whole.astype(np.int64) @ b.whole.astype(np.int64).T
    low, high = dualtree.node_intervals(a, b)
    for i, (start, stop) in enumerate(a.spans):
        for j, (first, last) in enumerate(b.spans):
            block = scores[start:stop, first:last]
            assert low[i, j] <= block.min() and block.max() <= high[i, j]
    seen = []
    exact = dualtree.scores_of
    monkeypatch.setattr(dualtree, "scores_of", lambda *x: seen.append(x) or exact(*x))
    caps, needs = np.full((60, 1), dualtree.HIGHEST), np.full((60, 1), dualtree.LOWEST)
    best = dualtree.search(a, b, caps, needs, True, 3)
    for at in range(60):
        fits = sorted(((int(scores[at, j]), ~int(b.ids[j])) for j in range(900) if a.labels[at] == b.labels[j]), reverse=True)[:3]
        assert best[at, 0] == fits
    seen.clear()
    a, b = packed(clouds(4, 400, 8, 1, 12), 8), packed(clouds(4, 2048, 8, 1, 12), 16)
    dualtree.search(a, b, np.full((400, 1), dualtree.HIGHEST), np.full((400, 1), dualtree.LOWEST), True, 3)
    leaves = sum(c is None for c in a.children) * sum(c is None for c in b.children)
    assert len(seen) < leaves / 4


def test_large_components_are_exact():
    rng = random.Random(5)
    rows = [(i, 0, [rng.randrange(-(1 << 17), 1 << 17) + 0.5 for _ in range(40)]) for i in range(50)]
    a = packed(rows, 8)
    assert a.norm[0] ** 2 > dualtree.EXACT
    got = dualtree.scores_of(a, a, slice(0, 5), slice(0, 50))
    assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in a.whole] for p in a.whole[:5]]


def test_query_agrees_with_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SMALL}/embeddings.parquet'")
    result = con.execute(ORACLES["op11_dual_tree"])
    names = [c[0] for c in result.description]
    got = dualtree.op11_dual_tree(spark, SMALL)
    assert sorted(got.columns) == sorted(names)
    expected = sorted(result.fetchall())
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == expected
    table = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert sorted(expected, key=lambda r: r) == sorted(plain(table, lambda i: i % 100 == 0))
