"""The rules of the two scorers, on words whose valences are given, and against plain scorers on many texts."""

import math
import random

import pytest

from moodspark.operators import opinions

from .plain_sentiment import AverageScorer, RuleScorer

VALENCES = {"good": 1.9, "bad": -2.5, "great": 3.1, "no": -1.2, ":)": 2.0, "fine": 0.8, "never": -0.5, "very": 9.0}
POLARITIES = {"fine": (0.4, 1.0), "awful": (-0.7, 1.0), "very": (0.0, 1.3), "slightly": (0.0, 0.7), "plain": (0.0, 1.0), "great": (0.9, 1.0)}
CASES = [
    ("good", 1.9),
    ("a good day.", 1.9),
    ("very good", 1.9 + 0.293),
    ("very very good", 1.9 + 0.293 + 0.293 * 0.95),
    ("slightly bad", -2.5 + 0.293),
    ("not good", 1.9 * -0.74),
    ("it isn't that good", 1.9 * -0.74),
    ("GOOD day", 1.9 + 0.733),
    ("GOOD", 1.9),
    ("VERY good day", 1.9 + 0.293 + 0.733),
    ("good!!", 1.9 + 2 * 0.292),
    ("good!!!!!!", 1.9 + 4 * 0.292),
    ("bad??", -2.5 - 0.36),
    ("bad????", -2.5 - 0.96),
    ("good but bad", 1.9 * 0.5 - 2.5 * 1.5),
    ("least good", 1.9 * -0.74),
    ("at least good", 1.9),
    ("no good", 1.9),
    ("never good", -0.5 + 1.9),
    ("day :)", 2.0),
    ("plain words", 0.0),
    ("", 0.0),
    (" \n", 0.0),
]


def compound(total):
    return round(total / math.sqrt(total * total + 15), 4)


@pytest.fixture(scope="module")
def valences(spark):
    return spark.createDataFrame(list(VALENCES.items()), "word string, valence double")


@pytest.fixture(scope="module")
def polarities(spark):
    return spark.createDataFrame([(w, *v) for w, v in POLARITIES.items()], "word string, polarity double, intensity double")


def scored(spark, texts, score):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    rows = score(df).collect()
    assert len(rows) == len(texts)
    return [r[1] for r in sorted(rows)]


def odd_texts():
    rng = random.Random(3)
    pool = ["good", "BAD", "great!", "No", "no", "very", "VERY", "slightly", "not", "isn't", "but", "least", "at", ":)", "fine,", "awful", "never", "plain", "x", "Thing", "...", "?", "!", "(great)", "doN'T", "don’t"]
    return [" ".join(rng.choice(pool) for _ in range(rng.randrange(14))) for _ in range(400)] + ["great fine " * 20_000 + "BUT bad!"]


def test_rules(spark, valences):
    got = scored(spark, [t for t, _ in CASES], lambda df: opinions.rule_scores(df, ["i"], "t", valences))
    assert got == pytest.approx([compound(total) for _, total in CASES], abs=1e-4)
    texts = odd_texts()
    plain = RuleScorer(VALENCES)
    assert scored(spark, texts, lambda df: opinions.rule_scores(df, ["i"], "t", valences)) == pytest.approx([plain(t) for t in texts], abs=1.01e-4)


def test_averages(spark, polarities):
    cases = [("fine", 0.4), ("very fine", 0.52), ("not fine", -0.2), ("fine. awful", -0.15), ("not. fine", 0.4), ("very plainly fine", 0.4), ("very not very fine", -0.338), ("", 0.0), ("none of it", 0.0)]
    assert scored(spark, [t for t, _ in cases], lambda df: opinions.average_scores(df, ["i"], "t", polarities)) == pytest.approx([s for _, s in cases])
    texts = odd_texts()
    plain = AverageScorer(POLARITIES)
    assert scored(spark, texts, lambda df: opinions.average_scores(df, ["i"], "t", polarities)) == pytest.approx([plain(t) for t in texts])


def test_null_texts_and_repeated_keys(spark, valences, polarities):
    df = spark.createDataFrame([(0, None), (0, "good"), (0, "good"), (None, "bad"), (1, "")], "i int, t string")
    rows = sorted(opinions.rule_scores(df, ["i"], "t", valences).collect(), key=str)
    assert [tuple(r) for r in rows] == sorted([(0, None), (0, compound(1.9)), (0, compound(1.9)), (None, compound(-2.5)), (1, 0.0)], key=lambda r: f"Row(i={r[0]}, score={r[1]})")
    assert opinions.average_scores(df, ["i"], "t", polarities).count() == 5
    assert opinions.rule_scores(df.where("false"), ["i"], "t", valences).collect() == []


def test_a_lexicon_that_repeats_a_word_multiplies_nothing(spark, valences):
    twice = valences.unionByName(valences).unionByName(spark.createDataFrame([(None, 1.0)], "word string, valence double"))
    assert scored(spark, ["not good no bad"], lambda df: opinions.rule_scores(df, ["i"], "t", twice)) == scored(spark, ["not good no bad"], lambda df: opinions.rule_scores(df, ["i"], "t", valences))


def test_lexicons_are_files(tmp_path, spark):
    (tmp_path / "v.txt").write_text("good\t1.9\t0.9\t[2, 2]\nbad\t-2.5\nbroken\n")
    (tmp_path / "p.xml").write_text("<sentiment><word form='fine' polarity='0.2' intensity='1.0'/><word form='fine' polarity='0.6' intensity='1.0'/></sentiment>")
    read = opinions.read_valences(spark, str(tmp_path / "v.txt"))
    assert {r.word: r.valence for r in read.collect()} == {"good": 1.9, "bad": -2.5}
    [word] = opinions.read_polarities(spark, str(tmp_path / "p.xml")).collect()
    assert (word.word, word.polarity, word.intensity) == ("fine", pytest.approx(0.4), 1.0)
    both = opinions.ensemble(spark.createDataFrame([(0, "love it"), (1, None), (2, "")], "i int, t string"), ["i"], "t", opinions.read_valences(spark, None), opinions.read_polarities(spark, None))
    assert {r.i: r.score for r in both.collect()} == {0: round(0.6 * compound(2.0) + 0.4 * 0.5, 4), 1: None, 2: 0.0}


def test_learned_valences_part_the_labels(spark):
    docs = spark.createDataFrame([(i, f"shared word {'bright' if i % 2 else 'gloom'} x{i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(31, None), (99, 1)], "doc_id long, quality int")
    learned = {r.word: r.valence for r in opinions.learn_valences(docs, labels, "doc_id", "text", "quality").collect()}
    assert set(learned) == {"bright", "gloom"} and learned["bright"] == -learned["gloom"] == pytest.approx(math.log(16), abs=1e-3)


def test_no_python_runs(spark, valences, polarities):
    df = spark.createDataFrame([(0, "good")], "i int, t string")
    plan = opinions.ensemble(df.repartition(2), ["i"], "t", valences, polarities)._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan
