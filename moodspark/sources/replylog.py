"""A log of what providers replied, under the hash of what they were asked.

Open prompts are asked in rounds; the replies of a round are in the log before the next begins, so a run that is killed
loses one round at most and the next run asks the rest only. Failed prompts are logged without a reply and asked again
by the next run. Once the log has many files it is compacted to the latest record of each prompt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodspark.operators.providers import complete
from moodspark.sources.files import exists, kept, listing, write_atomic

RECORD = "asked string, reply string, at timestamp"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The latest record of each prompt; one with a reply comes before any without. Empty where there is no log."""
    rows = spark.read.schema(RECORD).parquet(path) if exists(spark, path) else spark.createDataFrame([], RECORD)
    best = F.max_by(F.struct("reply", "at"), F.struct(F.col("reply").isNotNull(), "at", "reply"))
    return rows.groupBy("asked").agg(best.alias("r")).select("asked", "r.reply", "r.at")


def append(records: DataFrame, path: str) -> None:
    records.select("asked", "reply", "at").write.mode("append").parquet(path)


def compact(spark: SparkSession, path: str) -> None:
    """Keep the latest record of each prompt alone. Only one run at a time may write a log."""
    write_atomic(read_log(spark, path), path)


def ask(prompts: DataFrame, path: str, provider: Callable[[str], str], batch: str = "batch_id", per_round: int = 256, most_files: int = 200, **options) -> DataFrame:
    """The reply to each row of (batch, prompt), null for none: from the log, else asked for and added to it.

    Equal prompts are asked once. ``options`` are those of ``complete``.
    """
    spark = prompts.sparkSession
    named = prompts.select(batch, "prompt", F.sha2("prompt", 256).alias("asked"))
    known = read_log(spark, path).where(F.col("reply").isNotNull())
    pending = kept(named.join(known, "asked", "left_anti").groupBy("asked").agg(F.min(batch).alias(batch), F.first("prompt").alias("prompt")), "prompts")
    rounds = -(-pending.count() // per_round)
    for number in range(rounds):
        part = pending.where(F.pmod(F.xxhash64("asked"), F.lit(rounds)) == number).repartition(batch)
        replies = complete(part, provider, batch=batch, **options)
        append(part.select(batch, "asked").join(replies, batch).withColumn("at", F.current_timestamp()), path)
    if len(listing(spark, path)) > most_files:
        compact(spark, path)
    return named.join(read_log(spark, path), "asked", "left").select(batch, "reply")
