"""Weekly files as a stream: each batch updates the canonical entries of its titles and of no others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodspark.sources.feed import FEED, explode_weekly_feed
from moodspark.streaming.canonical import keep_canonical


def weekly_entries(spark: SparkSession, landing: str, files_per_batch: int = 16) -> DataFrame:
    """Entries of the JSON files that land in a folder."""
    feed = spark.readStream.schema(FEED).option("multiLine", True).option("maxFilesPerTrigger", files_per_batch).json(landing)
    return explode_weekly_feed(feed)


def distinct_entries(entries: DataFrame, delay: str = "30 days") -> DataFrame:
    """Entries that were not seen before within the delay: late copies of a week drop out."""
    timed = entries.withColumn("chart_time", F.to_timestamp("chart_date")).withWatermark("chart_time", delay)
    return timed.dropDuplicatesWithinWatermark(["chart_date", "title", "artist"])


def run_available(spark: SparkSession, landing: str, target: str, checkpoint: str, files_per_batch: int = 16) -> None:
    """Process all files that have landed, then stop; ``read_canonical`` gives the table."""
    keep_canonical(weekly_entries(spark, landing, files_per_batch), ("chart_date", "position"), target, checkpoint).awaitTermination()
