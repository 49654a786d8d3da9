"""Label scores of texts, learned in Spark from labelled texts.

``fit_bayes`` counts hashed words and word pairs by label: multinomial naive Bayes, one aggregation with a row for each label
and bucket, which combines before the shuffle, so a bucket that every text has is no hot key. The model is a table of
weights that is saved, read and joined; ``bayes_scores`` joins the tokens of a text to it and sums for each label. With
``buckets`` buckets it has that many rows at most, whatever the corpus.

``fit_regressions`` fits a logistic regression for each label against the rest with Spark's own learner, which sums
gradients over the executors in a tree; its labels need not exclude each other.

Null and empty texts have no tokens: naive Bayes gives them the labels' shares, the regressions their constants.
A text's tokens are summed as whole numbers of the weights' last digit, so that no order of summing changes a score.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 18
#: In place of a bucket: the rows of a label's own weight and of the weight that each token has before any count.
PRIOR, EACH = -1, -2
WORDS = r"[\p{L}\p{N}]+"
#: Weights have ten digits; they are summed as whole numbers of the last one.
UNITS = 10**10
MODEL = "label string, feature long, weight double"


def ngrams(text: str | Column) -> Column:
    """The lower-case words of a text and the pairs of neighbours, none for null."""
    value = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    words = F.regexp_extract_all(value, F.lit(WORDS), F.lit(0))
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, F.filter(pairs, F.isnotnull))


def bucket(ngram: str | Column, buckets: int) -> Column:
    """A hash that other engines have too: the first 32 bits of the MD5."""
    return F.conv(F.substring(F.md5(F.col(ngram) if isinstance(ngram, str) else ngram), 1, 8), 16, 10).cast("long") % buckets


def words_and_pairs(rows: DataFrame, text: str, buckets: int) -> DataFrame:
    """A row for each word with its bucket, ``one``, and that of the pair it begins, ``two``; a text without words keeps a row.

    As ``ngrams``, but the pairs are never listed: a word finds the next one where the text's words lie.
    """
    words = rows.withColumn("__words", F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORDS), F.lit(0)))
    tokens = words.select("*", F.posexplode_outer("__words").alias("__i", "__word"))
    pair = F.concat(F.col("__word"), F.lit(" "), F.get("__words", F.col("__i") + 1))
    return tokens.select(*(c for c in rows.columns if c != text), bucket("__word", buckets).alias("one"), bucket(pair, buckets).alias("two"))


def fit_bayes(df: DataFrame, text: str, label: str, buckets: int = BUCKETS) -> DataFrame:
    """The model of labelled texts; rows without a label take no part."""
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(text).alias("__text"))
    texts = rows.groupBy("label").agg(F.count("*").alias("n"))
    features = words_and_pairs(rows, "__text", buckets).select("label", F.explode(F.array("one", "two")).alias("feature")).where("feature IS NOT NULL")
    counts = features.groupBy("label", "feature").agg(F.count("*").alias("n"))
    each = texts.select("label").join(counts.groupBy("label").agg(F.sum("n").alias("n")), "label", "left")
    # A row a label: the share of a label among the texts needs their number, one row.
    total = texts.agg(F.sum("n").alias("total"))
    prior = texts.join(F.broadcast(total)).select("label", F.lit(PRIOR).cast("long").alias("feature"), F.log(F.col("n") / F.col("total")).alias("weight"))
    spread = each.select("label", F.lit(EACH).cast("long").alias("feature"), (-F.log(F.coalesce("n", F.lit(0)) + F.lit(float(buckets)))).alias("weight"))
    own = counts.select("label", "feature", F.log(F.col("n") + F.lit(1.0)).alias("weight"))
    return prior.unionByName(spread).unionByName(own).withColumn("weight", F.round("weight", 10))


def save_model(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def read_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL).parquet(path)


def bayes_scores(df: DataFrame, key: Sequence[str], text: str, model: DataFrame, buckets: int = BUCKETS, out: str = "scores") -> DataFrame:
    """The probability of each label for each row: ``key`` columns and a map. A model has a few labels, which are read first."""
    heads = {(r.label, r.feature): r.weight for r in model.where(F.col("feature") < 0).collect()}
    names = sorted({label for label, _ in heads})
    if not names:
        return df.select(*key, F.create_map().cast("map<string,double>").alias(out))
    # A row for a bucket with the weights of all labels in order, in units of the last digit: a table of ``buckets`` rows at most, which is broadcast.
    wide = model.where("feature >= 0").groupBy("feature").agg(*(F.round(F.coalesce(F.sum(F.when(F.col("label") == n, F.col("weight"))), F.lit(0.0)) * UNITS).cast("long").alias(f"w{i}") for i, n in enumerate(names)))
    rows = df.select(F.struct(*key).alias("__key"), F.monotonically_increasing_id().alias("__row"), F.col(text).alias("__text"))
    met = words_and_pairs(rows, "__text", buckets)
    for side in ("one", "two"):
        met = met.join(F.broadcast(wide.select(F.col("feature").alias(side), *(F.col(f"w{i}").alias(f"{side}{i}") for i in range(len(names))))), side, "left")
    both = lambda i: F.coalesce(F.sum(F.coalesce(f"one{i}", F.lit(0)) + F.coalesce(f"two{i}", F.lit(0))), F.lit(0))
    sums = met.groupBy("__key", "__row").agg((F.count("one") + F.count("two")).alias("n"), *((both(i) / F.lit(float(UNITS))).alias(f"w{i}") for i in range(len(names))))
    logs = [F.col(f"w{i}") + F.lit(heads[n, PRIOR]) + F.col("n") * F.lit(heads[n, EACH]) for i, n in enumerate(names)]
    powers = sums.select("__key", F.array(*logs).alias("l")).select("__key", F.transform("l", lambda x: F.exp(x - F.array_max("l"))).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return powers.select("__key.*", F.map_from_arrays(F.array(*map(F.lit, names)), F.transform("e", lambda x: F.round(x / total, 6))).alias(out))


def vectors(df: DataFrame, text: str, buckets: int) -> DataFrame:
    """Sparse vectors of which words and pairs a text has."""
    return HashingTF(numFeatures=buckets, binary=True, inputCol="__ngrams", outputCol="__vector").transform(df.withColumn("__ngrams", ngrams(text))).drop("__ngrams")


def fit_regressions(df: DataFrame, text: str, labels: Mapping[str, Column], buckets: int = BUCKETS, penalty: float = 0.01, rounds: int = 30) -> dict[str, LogisticRegressionModel]:
    """A regression for each label, whose column says whether a row has it; rows where it is null take no part."""
    rows = vectors(df, text, buckets)
    learner = LogisticRegression(featuresCol="__vector", labelCol="__label", regParam=penalty, maxIter=rounds, aggregationDepth=3, standardization=False)
    return {name: learner.fit(rows.select("__vector", has.cast("double").alias("__label")).where("__label IS NOT NULL")) for name, has in labels.items()}


def save_regressions(models: Mapping[str, LogisticRegressionModel], path: str) -> None:
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/{name}")


def read_regressions(path: str, names: Sequence[str]) -> dict[str, LogisticRegressionModel]:
    return {name: LogisticRegressionModel.load(f"{path}/{name}") for name in names}


def regression_scores(df: DataFrame, key: Sequence[str], text: str, models: Mapping[str, LogisticRegressionModel], out: str = "scores") -> DataFrame:
    """The probability of each label for each row, each by its own regression: ``key`` columns and a map."""
    buckets = next(iter(models.values())).numFeatures
    rows = vectors(df.select(F.struct(*key).alias("__key"), F.col(text).alias("__text")), "__text", buckets)
    found = []
    for i, model in enumerate(models.values()):
        rows = model.copy({model.rawPredictionCol: f"__raw{i}", model.probabilityCol: f"__p{i}", model.predictionCol: ""}).transform(rows)
        found.append(F.round(vector_to_array(f"__p{i}")[1], 6))
    return rows.select("__key.*", F.map_from_arrays(F.array(*map(F.lit, models)), F.array(*found)).alias(out))
