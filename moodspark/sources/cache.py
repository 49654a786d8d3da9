"""A read-through cache table of fetched documents, and the lookup behind it."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodspark.sources.files import exists

RECORD = "song_id string, lyrics string, status string"


def fetched_path(path: str) -> str:
    """Where records that were looked up are added, beside the folder of single files."""
    return f"{path.rstrip('/')}.fetched"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The records of a cache: one JSON file per id in ``path``, of which those that are empty or no JSON are misses, and what was looked up since.

    Of records of one id, one with a text counts.
    """
    rows = spark.createDataFrame([], RECORD)
    if exists(spark, path):
        files = spark.read.schema(RECORD + ", _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
        rows = files.where(F.col("_bad").isNull() & F.col("song_id").isNotNull()).drop("_bad")
    if exists(spark, fetched_path(path)):
        rows = rows.unionByName(spark.read.schema(RECORD).parquet(fetched_path(path)))
    best = F.max(F.struct(F.col("lyrics").isNotNull().alias("has"), "lyrics", "status")).alias("r")
    return rows.groupBy("song_id").agg(best).select("song_id", "r.lyrics", "r.status")


def cache_hits(requested: DataFrame, cache: DataFrame, key: str = "song_id") -> DataFrame:
    return requested.join(cache, key)


def cache_misses(requested: DataFrame, cache: DataFrame, key: str = "song_id") -> DataFrame:
    return requested.join(cache, key, "left_anti")


def fetch_missing(misses: DataFrame, provider: Callable[[str, str], str | None], tries: int = 3, pause: float = 0.5) -> DataFrame:
    """Look up (title, artist) by a provider; a lookup that fails gives a record of status 'missing'."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for key, title, artist in zip(part["song_id"], part["song_title"], part["artist"], strict=True):
                text = None
                for attempt in range(1, tries + 1):
                    try:
                        text = provider(title, artist)
                        break
                    except Exception:  # noqa: BLE001 - any failure of the provider is a failed try
                        if attempt < tries:
                            time.sleep(pause * attempt)
                out.append((key, text, "found" if text else "missing"))
            yield pd.DataFrame(out, columns=["song_id", "lyrics", "status"])

    return misses.select("song_id", "song_title", "artist").mapInPandas(run, RECORD)


def read_through(requested: DataFrame, cache: DataFrame, provider: Callable[[str, str], str | None], tries: int = 3, pause: float = 0.5) -> DataFrame:
    """Cached records and newly fetched ones of all requested ids."""
    found = cache_hits(requested.select("song_id"), cache).select("song_id", "lyrics", "status")
    return found.unionByName(fetch_missing(cache_misses(requested, cache), provider, tries, pause))


def fill(requested: DataFrame, path: str, provider: Callable[[str, str], str | None], tries: int = 3, pause: float = 0.5) -> DataFrame:
    """Look up what the cache at ``path`` lacks and add the records to it; the cache as it then is.

    Every requested id is asked for at most once over all runs, whatever came of it.
    """
    spark = requested.sparkSession
    made = fetch_missing(cache_misses(requested.dropDuplicates(["song_id"]), read_cache(spark, path)), provider, tries, pause)
    made.write.mode("append").parquet(fetched_path(path))
    return read_cache(spark, path)
