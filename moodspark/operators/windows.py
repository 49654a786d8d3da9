"""Operators that look at a row's cohort or place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodspark.sources.files import checkpointed

#: Cohorts that are broadcast at most; beyond, their means are joined by shuffle.
MOST_BROADCAST = 10_000


def impute_cohort_mean(df: DataFrame, cohort: str, columns: Sequence[str], by_window: bool = False) -> DataFrame:
    """Fill nulls by the cohort's mean. A row without a cohort loses its values, an all-null cohort stays null.

    The means are one two-phase aggregation joined back; ``by_window`` computes them in a window,
    which holds each cohort in one task and serves as a cross-check. A bounded cohort table is broadcast.
    """
    if by_window:
        over = Window.partitionBy(cohort)
        filled = {c: F.when(F.col(cohort).isNotNull(), F.coalesce(F.col(c).cast("double"), F.avg(c).over(over))) for c in columns}
        return df.withColumns(filled)
    means = df.where(F.col(cohort).isNotNull()).groupBy(cohort).agg(*(F.avg(c).alias(f"__mean_{c}") for c in columns))
    few = means.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    joined = df.join(F.broadcast(means) if few else means, cohort, "left")
    filled = {c: F.when(F.col(cohort).isNotNull(), F.coalesce(F.col(c).cast("double"), F.col(f"__mean_{c}"))) for c in columns}
    return joined.withColumns(filled).select(*df.columns)


def batch_assign(df: DataFrame, size: int, order: Sequence[str], part: str | None = None, out: str = "batch_id") -> DataFrame:
    """Number rows into batches of ``size`` in order, within ``part`` or else over the whole input.

    The rows are dealt out by ranges of ``part`` and order, sorted and written with their places, so that no task
    numbers more than a range, however large a part is, and a lost executor changes no number. How many rows
    of a part stand before a range is added up over ranges.
    """
    by = [part] if part is not None else []
    keys = [F.col(c) for c in [*by, *order]]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # monotonically_increasing_id is the partition's number in the high bits and the row's place in the low 33.
    numbered = ranged.withColumn("__id", F.monotonically_increasing_id())
    placed = checkpointed(numbered.withColumns({"__range": F.shiftright("__id", 33), "__row": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__id"))
    sizes = placed.groupBy("__range", *by).agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("__range").alias("__of"), *(F.col(c).alias("__part") for c in by), (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"))
    on = F.col("__range") == F.col("__of")
    if part is not None:
        on = on & F.col(f"`{part}`").eqNullSafe(F.col("__part"))
    joined = placed.join(before, on)
    return joined.withColumn(out, F.floor((F.col("__row") + F.col("__shift")) / size).cast("long")).select(*df.columns, out)


def canonical_sort(df: DataFrame, column: str, order: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """Sort by a given order of labels, others last; unchanged if the column is missing."""
    if column not in df.columns:
        return df
    return df.orderBy(canonical_place(column, order), column, *tie)


def canonical_place(column: str, order: Sequence[str]):
    """A label's place in the order, 999 for others and null."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return F.when(F.coalesce(place, F.lit(0)) == 0, 999).otherwise(place - 1).cast("long")


def ordered_labels(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """The distinct labels: known ones in order, others after them by alphabet."""
    distinct = df.where(F.col(column).isNotNull()).select(column).distinct()
    return distinct.withColumn("place", canonical_place(column, order)).orderBy("place", column)
