"""What larger tables showed: ties by rounding, tokens that moved, batches and ranges that grew with the tables."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from moodspark.functions import scores, text
from moodspark.operators import joins, labels, opinions, providers
from moodspark.plans import stream_queries

from .plain_sentiment import AverageScorer, RuleScorer

TONES = ("joy", "anger", "fear")


def plan(df):
    return df._jdf.queryExecution().toString()


def test_rounding_ties_no_labels(column):
    """Texts whose two best digests agree in six digits of their shares."""
    tone = lambda c: scores.dominant_label(providers.classify(c, TONES, providers.hashed_labels(TONES)), TONES)
    assert column(["text 315905", "text 884502"], tone) == ["anger", "fear"]


def test_batches_of_long_texts_are_bounded(spark):
    """40 texts of a million characters reach Python in parts, whichever of the two steps asked for it."""
    df = spark.createDataFrame([(i,) for i in range(40)], "i int").coalesce(1).select(F.repeat(F.lit("x"), 1_000_000).alias("t"))
    size = F.pandas_udf(lambda part: pd.Series([len(part)] * len(part)), "long")
    for step in (text.clean_text, lambda t: providers.classify(t, TONES, providers.hashed_labels(TONES))):
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        step("t")
        assert df.select(size("t").alias("n")).agg(F.max("n")).first()[0] <= 5


def test_listed_words_are_found_in_one_pass(spark, column):
    assert plan(spark.createDataFrame([("a",)], "t string").select(providers.listed_score("t").alias("s"))).split("== Optimized")[1].split("== Physical")[0].count("regexp_extract_all") == 1
    assert column(["Love, love! hate-free", "gloves", "", None, "BAD"], providers.listed_score) == [0.631, 0.0, 0.0, None, -0.6753]


@pytest.mark.parametrize("few", [0, 200_000])
def test_lexicons_meet_tokens_without_moving_them(spark, monkeypatch, few):
    """A table of few words is broadcast, a larger one merged with its frequent words dealt out; scores are the same."""
    monkeypatch.setattr(opinions, "FEW_WORDS", few)
    texts = ["not good no bad", "VERY good but bad!", None, "", "good " * 3000, "isn't that great"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    valences = spark.createDataFrame([("good", 1.9), ("bad", -2.5), ("great", 3.1), ("no", -1.2)], "word string, valence double").localCheckpoint()
    polarities = valences.select("word", (F.col("valence") / 4).alias("polarity"), F.lit(1.0).alias("intensity"))
    for scored, plain in ((opinions.rule_scores(df, ["i"], "t", valences), RuleScorer({r.word: r.valence for r in valences.collect()})), (opinions.average_scores(df, ["i"], "t", polarities), AverageScorer({r.word: (r.polarity, 1.0) for r in polarities.collect()}))):
        joins = plan(scored).split("== Physical")[1]
        assert ("SortMergeJoin" in joins) == (few == 0) and ("BroadcastHashJoin" in joins) == (few > 0)
        assert {r.i: r.score for r in scored.collect()} == {i: None if t is None else pytest.approx(plain(t), abs=1.01e-4) for i, t in enumerate(texts)}


def test_models_meet_tokens_without_moving_them(spark):
    model = labels.fit_bayes(spark.createDataFrame([("good", "a"), ("bad", "b")], "t string, l string"), "t", "l", 64)
    physical = plan(labels.bayes_scores(spark.createDataFrame([(0, "good")], "i int, t string"), ["i"], "t", model, 64)).split("== Physical")[1]
    assert "BroadcastHashJoin" in physical and "SortMergeJoin" not in physical


def test_ranges_with_the_same_ends_are_one(spark, monkeypatch):
    """30,000 ranges on 30 pairs of ends are few, so they are broadcast and each value meets 30 at most."""
    monkeypatch.setattr(joins, "FEW_RANGES", 1000)
    ranges = spark.range(30_000).select((F.col("id") % 30).alias("low"), (F.col("id") % 30 + 2).alias("high"), F.col("id").alias("x"), (-F.col("id")).alias("p"))
    found = joins.interval_lookup(spark.range(40).withColumnRenamed("id", "v"), "v", ranges, "low", "high", "x", "p", "x")
    side = plan(found).split("== Physical")[1]
    assert "__level" in side and not [line for line in side.split("\n") if "SortMergeJoin" in line and "__level" in line]
    assert {r.v: r.x for r in found.collect()} == {v: max((x for x in range(29_970, 30_000) if x % 30 <= v <= x % 30 + 2), default=None) for v in range(40)}


def test_entries_are_joined_once(spark, monkeypatch):
    """The landed rows are counted from their files, not by a second join."""
    counted = []
    whole = stream_queries.entries(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(whole, "count", lambda: counted.append(1), raising=False)
    monkeypatch.setattr(stream_queries, "entries", lambda *_: whole)
    assert stream_queries.stream_dedupe(spark, "/root/testdata/sf0.001").count() > 0 and not counted
