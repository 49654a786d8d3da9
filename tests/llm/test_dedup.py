"""Fingerprints, substring deduplication and the Jaccard join against plain code."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from moodspark.llm import common, doubling, fingerprints, jaccard, superkmers
from moodspark.llm.components import components
from moodspark.llm.packing import spread_out, squeeze

from .conftest import words


def plain_kept_words(rows, k=20):
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - k + 1):
            key = tuple(w[p : p + k])
            if key in seen:
                gone[p : p + k] = [True] * k
            seen.add(key)
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


def plain_kept_bytes(rows, n=200):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[p : p + n] for _, b in data for p in range(len(b) - n + 1))
    out = {}
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if count[b[p : p + n]] > 1:
                gone[p : p + n] = b"\1" * n
        runs = sum(1 for q in range(len(b)) if gone[q] and (q == 0 or not gone[q - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def passages(seed, docs=40):
    """Documents that share passages of many lengths, and some short periods."""
    rng = random.Random(seed)
    pool = [words(rng.random(), rng.randint(10, 90)) for _ in range(8)]
    texts = []
    for _ in range(docs):
        parts = []
        for _ in range(rng.randint(1, 5)):
            source = rng.choice(pool) if rng.random() < 0.6 else words(rng.random(), rng.randint(5, 60))
            start = rng.randrange(len(source))
            parts += source[start:] if rng.random() < 0.5 else source
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    return [*texts, "ab " * 150, "x" * 900, "xy" * 300, texts[0], texts[0]]


@pytest.mark.parametrize("seed", [1, 2])
def test_super_kmers(documents, hard_texts, seed):
    texts = hard_texts + passages(seed)
    df = superkmers.remove_repeats(documents(texts, 5, ["1 AS n_words", "2 AS spans"]), flush_bytes=4000, bucket_bytes=3000)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}
    assert got == plain_kept_words(list(enumerate(texts)))


@pytest.mark.parametrize("hot", [5, 20_000])
def test_super_kmers_with_a_run_in_every_window(documents, monkeypatch, hot):
    """A run of three words everywhere, alone and inside a common line; hot or not, the windows are counted exactly."""
    monkeypatch.setattr(superkmers, "HOT_RUNS", hot)
    rng = random.Random(9)
    line = words(77, 30)
    texts = []
    for i in range(60):
        body = []
        while len(body) < 150:
            body += ["of", "the", "day", *words(rng.random(), rng.randint(1, 4), 30)]
        texts.append(" ".join([*body, *line, *body[:40]] if i % 2 else [*line, *body]))
    df = superkmers.remove_repeats(documents(texts, 4), flush_bytes=4000, bucket_bytes=3000)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()} == plain_kept_words(list(enumerate(texts)))


def test_hot_minimisers_are_dealt_out():
    import numpy as np

    from moodspark.llm.packing import window_hashes_of

    numbers = np.arange(2000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    numbers[::3] = 7
    grams = window_hashes_of(numbers, 1)
    classes = np.zeros(1 << 16, dtype=np.uint8)
    classes[(grams & np.uint64(0xFFFF)).astype(int)] = 1
    classes[int(grams[0] & np.uint64(0xFFFF))] = 20
    owner = np.zeros(2000, dtype=np.int64)
    _, counts, deal = superkmers.super_kmers(numbers, owner, 20, 1, superkmers.Rarity(classes, 18))
    assert counts.sum() == 1981 and not (deal == grams[0]).any()
    first, counts, deal = superkmers.super_kmers(numbers, owner, 20, 1, superkmers.Rarity(np.full(1 << 16, 20, np.uint8), 18))
    assert counts.tolist() == [1] * 1981 and len(set(deal.tolist())) == 1981


def test_super_kmers_repeated_rows_and_missing_ids(documents, spark):
    text = " ".join(words(5, 40))
    docs = documents([(1, text), (1, text), (2, "short")]).unionByName(spark.sql("SELECT CAST(NULL AS LONG) doc_id, 'a' text, '' lang, '' source, 1L n_chars"))
    got = [(r.doc_id, r.n_removed) for r in superkmers.remove_repeats(docs).collect()]
    assert sorted(got, key=str) == [(1, 0), (1, 0), (2, 0), (None, 0)]
    assert superkmers.remove_repeats(documents([])).count() == 0
    long = " ".join(words(6, 90))
    mixed = documents([(1, long), (1, "short"), (0, long), (0, None)])
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in superkmers.remove_repeats(mixed).collect()) == [(0, 0, 0), (0, 90, 0), (1, 1, 0), (1, 90, 90)]


@pytest.mark.parametrize("seed", [1, 2])
def test_prefix_doubling(documents, hard_texts, seed, monkeypatch):
    monkeypatch.setattr(doubling, "PIECE", 700)
    texts = [t if t is None or len(t) < 20_000 else t[:5000] for t in hard_texts] + passages(seed)
    df = doubling.remove_repeats(documents(texts, 5, ["1 AS first"]), flush_rows=50)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}
    assert got == plain_kept_bytes(list(enumerate(texts)))


def test_prefix_doubling_edges(documents):
    assert doubling.remove_repeats(documents([])).count() == 0
    with pytest.raises(ValueError):
        doubling.remove_repeats(documents(["a"]), length=100)
    text = "".join(words(5, 90))
    got = [(r.n_removed, bytes(r.kept).decode()) for r in doubling.remove_repeats(documents([(1, text), (1, text)])).collect()]
    assert got == [(0, text)] * 2
    mixed = documents([(1, text), (1, "short"), (0, text), (0, None)])
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in doubling.remove_repeats(mixed).collect()) == [(0, 0, 0), (0, len(text), len(text)), (1, 5, 0), (1, len(text), len(text))]


def test_prefix_doubling_of_one_rank_everywhere(documents):
    """A line of 150 bytes in every document, between words of its own, and one of 260 bytes that repeats in full."""
    rng = random.Random(3)
    line, long = " ".join(words(11, 200))[:150], " ".join(words(12, 200))[:260]
    texts = []
    for _ in range(80):
        own = lambda n: " ".join(f"q{rng.randrange(10**9)}" for _ in range(n))
        texts.append(f"{own(12)} {line} {own(15)} {rng.choice([line, long])} {own(9)}")
    df = doubling.remove_repeats(documents(texts, 6), flush_rows=30)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()} == plain_kept_bytes(list(enumerate(texts)))


def test_blocks_come_back():
    import numpy as np

    arrays = [np.array([5, -3, 9], np.int64), np.array([1, 2**63], np.uint64), np.array([7], np.uint8), np.zeros(0, np.int32)]
    back = spread_out(squeeze(*arrays))
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, back, strict=True))


def plain_components(rows, size, percent):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().translate(jaccard.LOWER).split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i in sets:
        for t in sets[i]:
            where[t].append(i)
    for i in sets:
        met = Counter(j for t in sets[i] for j in where[t] if j < i)
        for j, n in met.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("size", "percent", "few"), [(3, 90, 200_000), (5, 80, 0)])
def test_jaccard_components(documents, hard_texts, size, percent, few, monkeypatch):
    """With small tables broadcast, and with none."""
    monkeypatch.setattr(common, "FEW_ROWS", few)
    for name, value in (("LARGE", 6), ("CHUNK", 8), ("PIVOTS", 2)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(size)
    texts = list(hard_texts)
    for copies in (40, 12, 3):
        base = words(rng.random(), rng.randint(60, 160), 4000)
        for _ in range(copies):
            edited = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                edited[rng.randrange(len(edited))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(edited))
    rng.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_components(documents(texts, 4, ["3 AS component_id", "4 AS n"]), size=size, percent=percent).collect()}
    assert got == plain_components(list(enumerate(texts)), size, percent)


def test_jaccard_links(documents, monkeypatch):
    for name, value in (("LARGE", 6), ("CHUNK", 8)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(9)
    texts = [None, "one", "One"]
    for copies in (40, 20, 5, 4):
        base = words(rng.random(), rng.randint(60, 160), 4000)
        for _ in range(copies):
            edited = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                edited[rng.randrange(len(edited))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(edited))
    rng.shuffle(texts)
    sets = [{tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set() for w in ((t or "").lower().split() for t in texts)]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 10 * len(sets[i] & sets[j]) >= 9 * len(sets[i] | sets[j])]
    first = [min([i] + [j for j in range(i) if s and sets[j] == s]) for i, s in enumerate(sets)]
    links, members = jaccard.similarity_links(documents(texts, 4))
    found = [(r.a, b) for r in links.collect() for b in r.others]
    assert sorted(found) == sorted({(first[j], first[i]) for i, j in linked if first[i] == i and first[j] == j and sets[i] != sets[j]})
    assert {r.doc_id: r.class_id for r in members.collect()} == dict(enumerate(first))
    counts = Counter(i for pair in linked for i in pair)
    assert {r.doc_id: r.n_links for r in jaccard.link_counts(links, members).collect()} == {i: counts[i] for i in range(len(texts))}


def test_jaccard_edges(documents):
    assert jaccard.similarity_components(documents([])).count() == 0
    rows = jaccard.similarity_components(documents([(7, "a b c d"), (7, "a b c d"), (9, "A b c d"), (3, None)])).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(3, 3), (7, 7), (9, 7)]


def test_other_texts_of_an_id_lose_nothing(documents):
    """A and C share 60 words, B is under A's id and unlike both."""
    shared, own = words(71, 60, 4000), words(72, 120, 4000)
    a, b, c = " ".join(shared + words(73, 30, 4000)), " ".join(own), " ".join(words(74, 30, 4000) + shared)
    rows = documents([(1, a), (1, b), (2, c), (None, b[:50]), (None, c)], 3)
    by_words = sorted(((r.doc_id, r.n_words, r.n_removed) for r in superkmers.remove_repeats(rows).collect()), key=str)
    assert by_words == sorted([(1, 90, 0), (1, 120, 0), (2, 90, 60), (None, len(b[:50].split()), 0), (None, 90, 90)], key=str)
    by_bytes = {(r.doc_id, r.n_bytes): r.n_removed for r in doubling.remove_repeats(rows).collect()}
    assert by_bytes[1, len(b)] == 0 and by_bytes[1, len(a)] > 200 and by_bytes[2, len(c)] == by_bytes[None, len(c)] == len(c)


def test_jaccard_rows_that_repeat_an_id(documents):
    """Each text of an id is a document."""
    base = words(41, 60, 4000)
    near, far = [*base[:-1], "other"], words(42, 60, 4000)
    base, near, far = " ".join(base), " ".join(near), " ".join(far)
    rows = documents([(5, far), (5, base), (2, near), (3, near), (5, base), (None, far), (None, "alone here today")], 2)
    got = sorted(((r.doc_id, r.component_id, r.n_rows) for r in jaccard.similarity_components(rows).collect()), key=str)
    assert got == sorted([(5, 2, 2), (5, 5, 1), (2, 2, 1), (3, 2, 1), (None, 5, 1), (None, None, 1)], key=str)


def test_words_of_regular_patterns_differ(documents):
    """Thue-Morse words and their complements, which polynomial hashes modulo 2^64 take for one another."""
    word = "a"
    for _ in range(12):
        word += word.translate({97: "b", 98: "a"})
    texts = [word, word.translate({97: "b", 98: "a"}), word]
    assert {r.doc_id: r.component_id for r in jaccard.similarity_components(documents(texts)).collect()} == {0: 0, 1: 1, 2: 0}


def test_frequency_classes(documents):
    import numpy as np
    import pyarrow as pa

    from moodspark.llm.sketch import frequency_classes

    tokens = lambda batch: np.repeat(batch.column(0).to_numpy().astype(np.uint64), 9)
    rows = documents([(i % 3, "t") for i in range(40)]).select("doc_id")
    classes, mean = frequency_classes(rows, tokens, 1 << 16)
    assert isinstance(pa.array(classes[:4]), pa.Array) and classes[:4].tolist() == [7, 7, 7, 0] and mean == 360 / (1 << 16)


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    got = {r.id: r.component for r in components(chain).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_components_of_shuffled_chains(spark):
    rng = random.Random(4)
    edges, expected = [], {9_000_000: 9_000_000}
    for start, n in ((0, 3000), (10_000, 1000), (20_000, 2)):
        order = list(range(start, start + n))
        rng.shuffle(order)
        edges += zip(order, order[1:])
        expected |= dict.fromkeys(order, start)
    edges.append((9_000_000, 9_000_000))
    rng.shuffle(edges)
    assert {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == expected


def test_fingerprint_likeness_is_unbiased(documents, hard_texts):
    def shingles(text):
        w = (text or "").split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    base = words(8, 400, 4000)
    texts = list(hard_texts)
    for n in range(1, 60):
        edited = list(base)
        for p in range(0, 400, n):
            edited[p] = f"e{n}"
        texts.append(" ".join(edited))
    df = fingerprints.add_fingerprint(documents(texts))
    pairs = df.select("doc_id", "fingerprint").crossJoin(df.where(F.col("doc_id") == len(texts) - 1).select(F.col("fingerprint").alias("other")))
    got = {r.doc_id: (r.x, r.h) for r in pairs.select("doc_id", fingerprints.likeness("fingerprint", "other").alias("x"), fingerprints.hexed("fingerprint").alias("h")).collect()}
    last = shingles(texts[-1])
    errors = [got[i][0] - len(shingles(t) & last) / max(1, len(shingles(t) | last)) for i, t in enumerate(texts)]
    assert max(map(abs, errors)) < 0.16 and abs(sum(errors) / len(errors)) < 0.03
    assert got[5][1] == got[6][1] == got[8][1] and got[0][1] == got[1][1] == got[2][1] == ""
    assert len(got[5][1]) == fingerprints.BINS * fingerprints.BITS // 4


def plain_fingerprint(text):
    """One-permutation MinHash step by step: bins, densification and packing of one text."""
    w = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
    runs = [w[i : i + 5] for i in range(len(w) - 4)] if len(w) >= 5 else ([[" ".join(w)]] if w else [])
    bins = {}
    for run in runs:
        h = 42
        for word in run:
            h = xxhash.xxh64(word.encode(), seed=h).intdigest()
        value = h >> 1 | 1
        place = value >> fingerprints.LOW
        bins[place] = min(value, bins.get(place, value))
    if not bins:
        return ""
    values = []
    for place in range(fingerprints.BINS):
        asked = [place, *(row[place] for row in fingerprints.donors()), *((place + 101 * k) % fingerprints.BINS for k in range(1, fingerprints.BINS))]
        values.append(next(bins[b] for b in asked if b in bins))
    return "".join(f"{v >> 1 & 15:x}" for v in values)


def test_fingerprints_match_plain_code(documents, hard_texts):
    texts = [*hard_texts, *(" ".join(words(i, n, 900)) for i, n in enumerate((1, 4, 5, 6, 30, 200, 900)))]
    df = fingerprints.add_fingerprint(documents(texts))
    got = {r.doc_id: r.h for r in df.select("doc_id", fingerprints.hexed("fingerprint").alias("h")).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(texts)}


def test_fingerprint_query(spark, tmp_path):
    texts = [None, "", "a b c", " ".join(words(1, 50)), "é" * 41, "x"]
    rows = [(10 * i, t) for i, t in enumerate(texts)] + [(20, "a b c"), (20, "a b c d"), (None, "lost")] + [(30, texts[3])] * 60 + [(40, texts[4])] * 50
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = fingerprints.op3_one_permutation(spark, str(tmp_path)).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(got) == len(texts)
    for i, text in enumerate(texts):
        own, after = text or "", texts[(i + 1) % len(texts)] or ""
        m = len(own) // 4
        assert got[10 * i].edited_sha256 == hashlib.sha256((own[: len(own) - m] + after[:m]).encode()).hexdigest() and got[10 * i].n_chars == len(own)
    assert got[0].near_next == 1.0 and got[10].near_next == 0.0
    plan = fingerprints.op3_one_permutation(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
