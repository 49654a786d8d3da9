"""Learned label scores: naive Bayes against plain code, the regression by its held-out ranking."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from moodspark.operators import labels

BUCKETS = 64
TRAIN = [("good day, good sun", "joy"), ("Good morning", "joy"), ("dark night", "fear"), ("dark dark wood", "fear"), ("night", "fear"), ("unlabelled text", None), ("", "joy")]
TEXTS = ["good", "dark night", "", None, "è una giornata good", "unseen words only", "good " * 5000]


def grams(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def bucket(gram):
    return int(hashlib.md5(gram.encode()).hexdigest()[:8], 16) % BUCKETS


def plain(train, text):
    names = sorted({label for _, label in train if label})
    known = [(t, label) for t, label in train if label]
    logs = []
    for name in names:
        counts = Counter(bucket(g) for t, label in known if label == name for g in grams(t))
        prior = sum(label == name for _, label in known) / len(known)
        logs.append(math.log(prior) + sum(math.log((counts[bucket(g)] + 1) / (sum(counts.values()) + BUCKETS)) for g in grams(text)))
    most = max(logs)
    total = sum(math.exp(x - most) for x in logs)
    return {n: math.exp(x - most) / total for n, x in zip(names, logs, strict=True)}


def test_bayes_is_the_plain_one(spark, tmp_path):
    labels.save_model(labels.fit_bayes(spark.createDataFrame(TRAIN, "text string, label string").repartition(3), "text", "label", BUCKETS), f"{tmp_path}/m")
    df = spark.createDataFrame([(i % 5, t) for i, t in enumerate(TEXTS)], "i int, text string").repartition(2)
    rows = labels.bayes_scores(df, ["i", "text"], "text", labels.read_model(spark, f"{tmp_path}/m"), BUCKETS).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert r.scores == pytest.approx(plain(TRAIN, r.text), abs=2e-6)


def test_no_labelled_texts(spark):
    model = labels.fit_bayes(spark.createDataFrame([("a", None)], "text string, label string"), "text", "label", BUCKETS)
    df = spark.createDataFrame([(1, "a")], "i int, text string")
    assert model.count() == 0 and labels.bayes_scores(df, ["i"], "text", model, BUCKETS).first().scores == {}


def test_regressions_rank_held_out_texts(spark, tmp_path):
    rng = random.Random(1)
    signs = {"warm": ["sun", "light", "glow"], "cold": ["ice", "frost", "snow"]}
    rows = []
    for i in range(300):
        has = {name: rng.random() < 0.4 for name in signs}
        words = [f"w{rng.randrange(80)}" for _ in range(20)] + [rng.choice(signs[n]) for n in signs for _ in range(2) if has[n]]
        rng.shuffle(words)
        rows.append((i, " ".join(words), has["warm"], has["cold"]))
    df = spark.createDataFrame(rows, "i int, text string, warm boolean, cold boolean")
    models = labels.fit_regressions(df.where("i < 200"), "text", {n: F.col(n) for n in signs}, 4096)
    labels.save_regressions(models, f"{tmp_path}/r")
    again = labels.read_regressions(f"{tmp_path}/r", list(signs))
    scored = labels.regression_scores(df.where("i >= 200"), ["i", "warm", "cold"], "text", again)
    for name in signs:
        pairs = scored.select(F.col(name).cast("double").alias("label"), array_to_vector(F.array(1 - F.col("scores")[name], F.col("scores")[name])).alias("rawPrediction"))
        assert BinaryClassificationEvaluator().evaluate(pairs) > 0.95


def test_labels_of_documents_are_found(spark):
    """Toxic documents, from rows that were not learned from."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    models = labels.fit_regressions(docs.where(~held), "text", {"toxic": F.col("toxic") == 1, "good": F.col("quality") == 1}, 1 << 16)
    scored = labels.regression_scores(docs.where(held), ["toxic", "quality"], "text", models)
    for name, column in (("toxic", "toxic"), ("good", "quality")):
        pairs = scored.select(F.col(column).cast("double").alias("label"), array_to_vector(F.array(1 - F.col("scores")[name], F.col("scores")[name])).alias("rawPrediction"))
        assert BinaryClassificationEvaluator().evaluate(pairs) > 0.75
