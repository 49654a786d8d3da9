"""The cohort mood index, its gates and the contrast layer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodspark.functions import scores
from moodspark.operators import aggregates, windows

COMPONENTS = ("sentiment_score", "energy_level", "development_score")


class CoverageError(RuntimeError):
    """Too few rows have what a stage needs; nothing was written."""


def with_resonance(df: DataFrame, cohort: str = "decade", weights: Mapping[str, float] | None = None, renormalise_missing: bool = False) -> DataFrame:
    """Impute the components by cohort and add ``cultural_resonance_score``."""
    filled = windows.impute_cohort_mean(df, cohort, COMPONENTS)
    return filled.withColumn("cultural_resonance_score", scores.resonance_score(weights=weights, renormalise_missing=renormalise_missing))


def cohort_mood_index(df: DataFrame, order: Sequence[str], cohort: str = "decade", title: str = "song_title", top_themes: int = 5, top_titles: int = 3) -> DataFrame:
    """One row per cohort: sizes, means, modes and tops. Rows without a cohort don't count.

    One aggregation and two small top lists; the lists are aggregated before they are joined.
    """
    rows = df.where(F.col(cohort).isNotNull())
    base = rows.groupBy(cohort).agg(
        F.count("*").alias("song_count"),
        F.count("cultural_resonance_score").alias("scored_count"),
        F.avg("sentiment_score").alias("CMI_sentiment"),
        F.avg("energy_level").alias("CMI_energy"),
        aggregates.mode_value("emotional_tone").alias("emotional_tone"),
        aggregates.mode_excluding("jung_stage", "unclassified").alias("dominant_jung_stage"),
    )
    tags = aggregates.top_tags(rows, cohort, "themes", order, top_themes).withColumnRenamed("top_tags", "top_themes")
    titles = aggregates.top_titles(rows, cohort, title, "cultural_resonance_score", order, top_titles).withColumnRenamed("top_titles", "top_resonance_songs")
    return base.join(tags, cohort, "left").join(titles, cohort, "left").withColumnRenamed(cohort, "decade_label")


def contrast(df: DataFrame, bins: Sequence[float] = scores.BINS) -> DataFrame:
    """Add what the chorus has against the whole text."""
    return df.withColumns(
        {
            "contrast_sentiment_index": scores.contrast_index("chorus_detected", "chorus_sentiment_score", "sentiment_score"),
            "energy_shift": scores.energy_shift("chorus_detected", "chorus_sentiment_score", "energy_level", bins),
            "theme_shift": scores.theme_shift("chorus_detected", "themes", "emotional_tone", "chorus_emotional_tone"),
        }
    )


def enforce_coverage(df: DataFrame, threshold: float = 0.85, quality: str = "lyrics_quality", score: str = "sentiment_score") -> float:
    """The coverage of full-quality rows; raises below the threshold, equality passes."""
    rate = df.agg(aggregates.coverage_rate(quality, score).alias("rate")).first()["rate"]
    if rate < threshold:
        raise CoverageError(f"{score}: {rate:.4f} of full-quality rows are scored, {threshold} are needed")
    return rate


def enforce_nonnull(df: DataFrame, column: str = "cultural_resonance_score", threshold: float = 0.60) -> float:
    """The share of rows with a value; an empty table has none."""
    rate = df.agg(aggregates.nonnull_fraction(column).alias("rate")).first()["rate"] or 0.0
    if rate < threshold:
        raise CoverageError(f"{column}: {rate:.4f} of the rows have a value, {threshold} are needed")
    return rate
