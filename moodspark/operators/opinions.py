"""Sentiment of texts as a relation of tokens that is joined to a lexicon: no text leaves the JVM.

``rule_scores``: valences with boosters, negations, capitals, punctuation and the turn at "but" (Hutto and Gilbert,
"VADER: a parsimonious rule-based model for sentiment analysis of social media text", 2014), -1 to 1.
``average_scores``: the mean polarity of the words found, with intensities and negations, as in the pattern analyser, -1 to 1.

Every token carries what the rules ask of its neighbours, so tokens are exploded, meet the lexicon, which is broadcast after
a count, and are summed for their row before anything is shuffled; of a text without a word of the lexicon one row is left. Contributions are
summed as decimals, so that no order of summing changes a score. Null texts have no score, texts without a hit have 0.
A lexicon is a table of its own, read from a file or learned from labelled texts (``learn_valences``), and may be of any size.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import punctuation

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodspark.functions.scores import ensemble_score
from moodspark.operators.providers import ALPHA, NEGATIVE, POSITIVE

# Fixed values of the rules: what boosters, capitals and negations add or multiply, and the words that do so.
BOOST, CAPITALS, NEGATED = 0.293, 0.733, -0.74
STRONGER = tuple("absolutely amazingly awfully completely considerably decidedly deeply enormously entirely especially exceptionally extremely fabulously fully greatly highly hugely incredibly intensely majorly more most particularly purely quite really remarkably so substantially thoroughly totally tremendously unbelievably unusually utterly very".split())
WEAKER = tuple("almost barely hardly kinda less little marginally occasionally partly scarcely slightly somewhat sorta".split())
NEGATIONS = tuple("aint arent cannot cant couldnt darent didnt doesnt dont hadnt hasnt havent isnt mightnt mustnt neither neednt never none nope nor not nothing nowhere oughtnt rarely seldom shant shouldnt uhuh wasnt werent without wont wouldnt despite".split())
#: How much of a booster's weight is left one, two and three words before the word it boosts.
DISTANCE = (1.0, 0.95, 0.9)
#: ASCII white space, and the punctuation that is cut off around a word.
BLANKS = r"[\x20\x09-\x0D]+"
EDGES = r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+\z"
#: Words, with an apostrophe inside them, and the marks that end a sentence.
WORDS_AND_MARKS = r"\p{L}+(?:'\p{L}+)?|[.!?]"
#: Words of a lexicon that is broadcast, some 20 MB, and the deals of a word's tokens where a larger one is merged.
FEW_WORDS, DEALS = 200_000, 32
#: Digits that a contribution keeps.
PRECISE = "decimal(24,10)"


def is_negation(low: Column) -> Column:
    """Whether a lower-case word negates."""
    return F.translate(low, "'’", "").isin(*NEGATIONS) | low.contains("n't")


def words_of(text: str) -> Column:
    """Words without the punctuation around them; short tokens, such as emoticons, stay as they are."""
    tokens = F.filter(F.split(F.col(text), BLANKS), lambda t: t != "")
    bare = F.transform(tokens, lambda t: F.struct(t.alias("t"), F.btrim(t, F.lit(punctuation)).alias("b")))
    return F.transform(bare, lambda w: F.when(F.length(w["b"]) <= 2, w["t"]).otherwise(w["b"]))


def unique_words(lexicon: DataFrame, *values: str) -> DataFrame:
    """One row a word, so that a lexicon that repeats one multiplies no token."""
    return lexicon.where("word IS NOT NULL").groupBy("word").agg(*(F.avg(v).alias(v) for v in values))


def is_loud(word: Column) -> Column:
    """Whether a word of two or more characters is in capitals."""
    return (F.upper(word) == word) & (F.lower(word) != word) & (F.length(word) > 1)


def with_words(tokens: DataFrame, words: DataFrame, column: str, few: bool) -> DataFrame:
    """Left join of tokens to a table of words. A table of few words is broadcast, so no token moves.

    A larger one is merged: the tokens of a frequent word, and those that have none, are dealt out by their row, and every word
    has a copy for each deal.
    """
    if few:
        return tokens.join(F.broadcast(words.withColumnRenamed("word", column)), column, "left")
    dealt = tokens.withColumn("__deal", F.pmod(F.xxhash64("__row"), F.lit(DEALS)).cast("int"))
    copies = words.withColumnRenamed("word", column).withColumn("__deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    return dealt.join(copies.hint("merge"), [column, "__deal"], "left").drop("__deal")


def rule_scores(df: DataFrame, key: Sequence[str], text: str, lexicon: DataFrame, out: str = "score") -> DataFrame:
    """The compound score of each row: ``key`` columns and ``out``. ``lexicon``: (word, valence)."""
    few = lexicon.count() <= FEW_WORDS
    scored = unique_words(lexicon.where(~F.col("word").isin(*STRONGER, *WEAKER)), "valence")
    rows = df.select(F.struct(*key).alias("__key"), F.col(text).alias("__text"), F.monotonically_increasing_id().alias("__row"), F.coalesce(words_of(text), F.array().cast("array<string>")).alias("__words"))
    rows = rows.withColumn("__lows", F.transform("__words", F.lower))
    mixed = F.exists("__words", is_loud) & F.exists("__words", lambda w: ~is_loud(w))
    count = lambda mark: F.length(F.col("__text")) - F.length(F.replace(F.col("__text"), F.lit(mark), F.lit("")))
    asks = count("?")
    marks = F.least(count("!"), F.lit(4)) * 0.292 + F.when(asks < 2, 0.0).when(asks <= 3, asks * 0.18).otherwise(0.96)
    # The last element stands for the row itself, which is kept whether or not a word is found.
    rows = rows.select("__key", "__row", "__words", "__lows", F.concat("__lows", F.array(F.lit(None).cast("string"))).alias("__each"), mixed.alias("__mixed"), F.array_position("__lows", "but").alias("__turn"), marks.alias("__marks"), F.col("__text").isNull().alias("__null"))
    tokens = rows.select("*", F.posexplode("__each").alias("i", "low"))
    # What the rules ask of the words around: fields of the token, the arrays stay behind.
    before = lambda b: F.get("__lows", F.col("i") - b)

    def boost(b: int) -> Column:
        extra = F.when(F.col("__mixed") & is_loud(F.get("__words", F.col("i") - b)), F.lit(CAPITALS)).otherwise(0.0)
        return F.when(before(b).isin(*STRONGER), F.lit(BOOST) + extra).when(before(b).isin(*WEAKER), F.lit(-BOOST) - extra).otherwise(0.0)

    least = (before(1) == "least") & ~F.coalesce(before(2).isin("at", "very"), F.lit(False))
    tokens = tokens.select(
        "__key", "__row", "__marks", "__mixed", "__turn", "__null", "i", "low",
        is_loud(F.get("__words", F.col("i"))).alias("loud"),
        *(boost(b).alias(f"boost{b}") for b in (1, 2, 3)),
        *(F.when(is_negation(before(b)), before(b)).alias(f"negation{b}") for b in (1, 2, 3)),
        F.coalesce(least, F.lit(False)).alias("least"),
        F.when(F.col("low") == "no", F.get("__lows", F.col("i") + 1)).alias("next"),
    )
    hits = with_words(tokens, scored, "low", few).where(F.col("valence").isNotNull() | F.col("low").isNull())
    # A negation that the lexicon scores itself doesn't negate; "no" before a scored word isn't scored.
    for column in ("negation1", "negation2", "negation3", "next"):
        known = unique_words(lexicon, "valence") if column == "next" else scored.where(is_negation(F.col("word")))
        hits = with_words(hits, known.select("word", F.lit(True).alias(f"{column}_scored")), column, few)
    sign = F.signum("valence")
    value = F.col("valence") + F.when(F.col("__mixed") & F.col("loud"), sign * CAPITALS).otherwise(0.0)
    for b, share in enumerate(DISTANCE, 1):
        value = value + sign * F.col(f"boost{b}") * share
        value = F.when(F.col(f"negation{b}").isNotNull() & F.col(f"negation{b}_scored").isNull(), value * NEGATED).otherwise(value)
    value = F.when(F.col("least"), value * NEGATED).otherwise(value)
    value = F.when(F.col("next_scored"), 0.0).otherwise(value)
    place = F.col("i") + 1
    value = value * F.when((F.col("__turn") == 0) | (place == F.col("__turn")), 1.0).when(place < F.col("__turn"), 0.5).otherwise(1.5)
    sums = hits.groupBy("__key", "__row", "__marks", "__null").agg(F.coalesce(F.sum(F.round(value, 10).cast(PRECISE)), F.lit(0)).cast("double").alias("__sum"))
    total = F.col("__sum") + F.signum("__sum") * F.col("__marks")
    compound = F.round(F.greatest(F.least(total / F.sqrt(total * total + ALPHA), F.lit(1.0)), F.lit(-1.0)), 4)
    return sums.select("__key.*", F.when(~F.col("__null"), compound).alias(out))


def average_scores(df: DataFrame, key: Sequence[str], text: str, lexicon: DataFrame, out: str = "score") -> DataFrame:
    """The mean polarity of each row's words: ``key`` columns and ``out``. ``lexicon``: (word, polarity, intensity).

    A word of no polarity whose intensity isn't 1 multiplies the next word, a negation turns it by half; the end of a
    sentence and every word that counts begin anew, any other word ends an intensity. The fold goes over the words
    that the lexicon knows, the negations and the marks of one row.
    """
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORDS_AND_MARKS), F.lit(0))
    rows = df.select(F.struct(*key).alias("__key"), F.monotonically_increasing_id().alias("__row"), F.col(text).isNull().alias("__null"), F.coalesce(F.concat(found, F.array(F.lit(""))), F.array(F.lit(""))).alias("__found"))
    tokens = rows.select("__key", "__row", "__null", F.posexplode("__found").alias("i", "low"))
    met = with_words(tokens, unique_words(lexicon, "polarity", "intensity"), "low", lexicon.count() <= FEW_WORDS)
    kind = F.when(F.col("low") == "", "end").when(F.col("low").isin(".", "!", "?"), "mark").when(is_negation(F.col("low")) | (F.col("low") == "no"), "negation").when((F.col("polarity") == 0) & (F.col("intensity") != 1), "intensity").when(F.col("polarity").isNotNull(), "value")
    events = met.withColumn("kind", kind).where("kind IS NOT NULL")
    listed = events.groupBy("__key", "__row", "__null").agg(F.array_sort(F.collect_list(F.struct("i", "kind", "polarity", "intensity"))).alias("__events"))
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.lit(1.0).alias("strength"), F.lit(False).alias("turned"), F.lit(-1).alias("last"))

    def fold(acc: Column, e: Column) -> Column:
        strength = F.when(e["i"] > acc["last"] + 1, 1.0).otherwise(acc["strength"])
        value = F.greatest(F.least(e["polarity"] * strength, F.lit(1.0)), F.lit(-1.0))
        counts, begins = e["kind"] == "value", e["kind"].isin("value", "mark")
        return F.struct(
            F.when(counts, acc["total"] + F.when(acc["turned"], value * -0.5).otherwise(value)).otherwise(acc["total"]).alias("total"),
            F.when(counts, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
            F.when(begins, 1.0).when(e["kind"] == "intensity", strength * e["intensity"]).otherwise(strength).alias("strength"),
            F.when(begins, False).when(e["kind"] == "negation", True).otherwise(acc["turned"]).alias("turned"),
            e["i"].alias("last"),
        )

    mean = F.aggregate("__events", start, fold, lambda acc: F.when(acc["n"] == 0, 0.0).otherwise(acc["total"] / acc["n"]))
    return listed.select("__key.*", F.when(~F.col("__null"), mean).alias(out))


def read_valences(spark: SparkSession, path: str | None) -> DataFrame:
    """A lexicon of lines of word, tab, mean valence and more columns; without a path the offline word lists."""
    if path is None:
        rows = [(w, 2.0) for w in POSITIVE] + [(w, -2.0) for w in NEGATIVE]
        return spark.createDataFrame(rows, "word string, valence double")
    lines = spark.read.text(path).select(F.split("value", "\t").alias("p")).where(F.size("p") > 1)
    return lines.select(F.col("p")[0].alias("word"), F.col("p")[1].cast("double").alias("valence"))


def read_polarities(spark: SparkSession, path: str | None) -> DataFrame:
    """A lexicon of XML ``word`` elements with form, polarity and intensity, senses averaged; without a path the offline word lists."""
    fixed = [(w, 0.0, 1.3) for w in STRONGER] + [(w, 0.0, 0.7) for w in WEAKER]
    if path is None:
        rows = [(w, 0.5, 1.0) for w in POSITIVE] + [(w, -0.5, 1.0) for w in NEGATIVE] + fixed
        return spark.createDataFrame(rows, "word string, polarity double, intensity double")
    senses = spark.read.format("xml").option("rowTag", "word").schema("_form string, _polarity double, _intensity double").load(path)
    return senses.groupBy(F.col("_form").alias("word")).agg(F.avg(F.coalesce("_polarity", F.lit(0.0))).alias("polarity"), F.avg(F.coalesce("_intensity", F.lit(1.0))).alias("intensity"))


def learn_valences(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, least: int = 5, strongest: float = 4.0, weakest: float = 0.5) -> DataFrame:
    """A lexicon from texts labelled 1 and 0: how much likelier a word is in a document of the one than of the other, in logarithms.

    Words of three or more letters in at least ``least`` labelled documents count, those below ``weakest`` go. Two
    aggregations: words by document, documents by word; the second has a row a word.
    """
    marked = docs.join(labels.where(F.col(label).isin(0, 1)).select(key, F.col(label).cast("int").alias("__label")), key)
    # One row: the number of documents of each label.
    totals = marked.agg(F.count_if(F.col("__label") == 1).alias("__p"), F.count_if(F.col("__label") == 0).alias("__n"))
    words = marked.select("__label", F.explode(F.array_distinct(F.transform(words_of(text), F.lower))).alias("word")).where(F.col("word").rlike("^[a-z]{3,}$"))
    counted = words.groupBy("word").agg(F.count_if(F.col("__label") == 1).alias("p"), F.count_if(F.col("__label") == 0).alias("n")).where(F.col("p") + F.col("n") >= least)
    odds = F.log((F.col("p") + 1) / (F.col("__p") + 2)) - F.log((F.col("n") + 1) / (F.col("__n") + 2))
    valence = F.round(F.greatest(F.least(odds, F.lit(strongest)), F.lit(-strongest)), 3)
    return counted.join(F.broadcast(totals)).select("word", valence.alias("valence")).where(F.abs("valence") >= weakest)


def polarities_of(valences: DataFrame, strongest: float = 4.0) -> DataFrame:
    """Learned valences as a lexicon of polarities, with the boosters as intensities."""
    fixed = valences.sparkSession.createDataFrame([(w, 0.0, 1.3) for w in STRONGER] + [(w, 0.0, 0.7) for w in WEAKER], "word string, polarity double, intensity double")
    return valences.where(~F.col("word").isin(*STRONGER, *WEAKER)).select("word", (F.col("valence") / strongest).alias("polarity"), F.lit(1.0).alias("intensity")).unionByName(fixed)


def ensemble(df: DataFrame, key: Sequence[str], text: str, valences: DataFrame, polarities: DataFrame, out: str = "score") -> DataFrame:
    """Both scores weighted, in -1 to 1 with four digits; ``key`` names a row."""
    both = rule_scores(df, key, text, valences, "__rules").join(average_scores(df, key, text, polarities, "__mean"), list(key))
    return both.select(*key, ensemble_score("__rules", "__mean").alias(out))
