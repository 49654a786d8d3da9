"""The weekly ranking feed: its calendar, its landed JSON and a fetcher."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEED = "date string, data array<struct<song:string,artist:string,peak_position:long,weeks_on_chart:long>>"


class FeedError(RuntimeError):
    """A week has no usable entries, or too few weeks were fetched."""


def first_saturday(start_year: int | Column) -> Column:
    """The first Saturday on or after January 1."""
    year = F.lit(start_year) if isinstance(start_year, int) else start_year
    return F.next_day(F.date_sub(F.make_date(year, F.lit(1), F.lit(1)), 1), "SAT")


def week_calendar(spark: SparkSession, start_year: int, end_year: int) -> DataFrame:
    """All Saturdays from the start year to the end year."""
    end = F.make_date(F.lit(end_year), F.lit(12), F.lit(31))
    return spark.range(1).select(F.explode(F.sequence(first_saturday(start_year), end, F.expr("interval 7 days"))).alias("week"))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEED).option("multiLine", True).json(path)


def explode_weekly_feed(feed: DataFrame) -> DataFrame:
    """One row per entry with its place; entries with a blank title or artist go."""
    rows = feed.select(F.to_date("date").alias("chart_date"), F.posexplode("data").alias("position", "e"))
    rows = rows.select("chart_date", "position", F.trim("e.song").alias("title"), F.trim("e.artist").alias("artist"), F.col("e.peak_position").alias("rank"), F.col("e.weeks_on_chart").alias("weeks"))
    return rows.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("artist", F.lit("")) != ""))


def union_weeks(*weeks: DataFrame) -> DataFrame:
    out = weeks[0]
    for week in weeks[1:]:
        out = out.unionByName(week, allowMissingColumns=True)
    return out


def feed_coverage(calendar: DataFrame, landed: DataFrame, week: str = "week") -> DataFrame:
    """The share of the calendar's weeks that have landed."""
    have = landed.select(F.to_date("chart_date").alias(week)).distinct().withColumn("landed", F.lit(1))
    return calendar.join(have, week, "left").agg(F.count("*").alias("expected"), F.count("landed").alias("fetched"), F.avg(F.col("landed").isNotNull().cast("double")).alias("coverage"))


def fetch_week(url: str, tries: int = 3, timeout: float = 30, pause: float = 2.0, get: Callable | None = None) -> dict:
    """One week's JSON by HTTP. A 404 is not tried again; a week without usable entries is an error."""
    get = get or (lambda u: urllib.request.urlopen(u, timeout=timeout).read())
    last: Exception | None = None
    for attempt in range(1, tries + 1):
        try:
            value = json.loads(get(url))
            entries = [e for e in value.get("data", []) if str(e.get("song") or "").strip() and str(e.get("artist") or "").strip()]
            if not entries:
                raise FeedError(f"{url}: no entries")
            return value | {"data": entries}
        except urllib.error.HTTPError as error:
            if error.code == 404:
                raise FeedError(f"{url}: not found") from error
            last = error
        except (OSError, ValueError) as error:
            last = error
        if attempt < tries:
            time.sleep(pause * attempt)
    raise FeedError(f"{url}: {last}")


def enforce_feed_coverage(coverage: DataFrame, threshold: float = 0.80) -> float:
    rate = coverage.first()["coverage"] or 0.0
    if rate < threshold:
        raise FeedError(f"{rate:.4f} of the weeks were fetched, {threshold} are needed")
    return rate
