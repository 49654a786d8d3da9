"""Joins and lookups on a shared key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def left_join_suffix(left: DataFrame, right: DataFrame, key: str, suffix: str) -> DataFrame:
    """Left join; columns that both have keep their name on the left and take the suffix on the right."""
    taken = set(left.columns)
    named = right.select(*(F.col(f"`{c}`").alias(c if c == key or c not in taken else f"{c}{suffix}") for c in right.columns))
    return left.join(named, key, "left")


def left_join_layers(spine: DataFrame, layers: Sequence[tuple[DataFrame, str]], key: str) -> DataFrame:
    """Left join several layers on one key: Spark keeps the spine's partitioning from join to join."""
    for layer, suffix in layers:
        spine = left_join_suffix(spine, layer, key, suffix)
    return spine


def left_join_pruned(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    return left.join(right.select(key, *columns), key, "left")


def join_replace(left: DataFrame, right: DataFrame, key: str, fill: Mapping[str, object]) -> DataFrame:
    """Left join in which the right side's columns replace the left's; unmatched rows get the fill values."""
    joined = left.drop(*fill).join(right.select(key, *fill), key, "left")
    return joined.select(*(c for c in joined.columns if c not in fill), *(F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in fill.items()))


def range_bucket_case(value: str | Column, buckets: Sequence[tuple[str, int, int]]) -> Column:
    """The label of the first bucket that holds the value, null for none: one CASE, no join."""
    v = F.col(value) if isinstance(value, str) else value
    out = F.lit(None).cast("string")
    for label, low, high in reversed(buckets):
        out = F.when(v.between(low, high), label).otherwise(out)
    return out


def range_bucket_join(df: DataFrame, value: str, buckets: Sequence[tuple[str, int, int]], out: str = "bucket") -> DataFrame:
    """As the CASE, from a table of buckets."""
    table = df.sparkSession.createDataFrame([(*b, i) for i, b in enumerate(buckets)], "label string, low long, high long, place long")
    keyed = df.withColumn("__value", F.col(value).cast("long"))
    return interval_lookup(keyed, "__value", table, "low", "high", "label", "place", out).drop("__value")


#: Ranges of one width that are broadcast at most.
FEW_RANGES = 100_000


def line_position(value: Column, kind: str) -> Column:
    """A value of an ordered type as a number in the same order: days, microseconds, integers, or floating point."""
    if kind == "date":
        return F.unix_date(value).cast("long")
    if kind.startswith("timestamp"):
        return F.unix_micros(value.cast("timestamp"))
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return value.cast("long")
    if kind in ("float", "double") or kind.startswith("decimal"):
        return value.cast("double")
    raise TypeError(f"values of type {kind} have no place on a line")


def interval_lookup(df: DataFrame, value: str, ranges: DataFrame, low: str, high: str, payload: str, priority: str, out: str) -> DataFrame:
    """Add the ``payload`` of the first range by ``priority`` (then by payload) that holds the value, both ends included; null for none.

    A range lies in cells of the power of two that is no narrower than itself, so it has two cells (three where rounding
    has it so), however wide it is; a value asks its one cell in each width that there is. Widths with few ranges, as
    the wide ones mostly are, are broadcast after a count; those with many are joined by (width, cell), where Spark splits a
    cell with many values. Ranges with the same ends are reduced to their first before. Values are asked once each: rows that share one meet its answer by a join. Null values, null
    and not-a-number ends and ranges that end before they begin match nothing. Any number, date or timestamp can be a value.
    """
    kind = dict(df.dtypes)[value]
    whole = kind in ("date", "tinyint", "smallint", "int", "bigint") or kind.startswith("timestamp")
    of_type = df.schema[value].dataType
    placed = ranges.select(F.col(low).cast(of_type).alias("__low"), F.col(high).cast(of_type).alias("__high"), F.col(payload).alias("__payload"), F.col(priority).alias("__priority"))
    placed = placed.withColumns({"__from": line_position(F.col("__low"), kind), "__to": line_position(F.col("__high"), kind)}).where("__from <= __to")
    # Of ranges with the same ends the first answers for all. On a line of few places, such as days, few are left.
    placed = placed.groupBy("__low", "__high", "__from", "__to").agg(F.min(F.struct("__priority", "__payload")).alias("__first")).select("*", "__first.*").drop("__first")
    width = F.col("__to").cast("double") - F.col("__from").cast("double")
    if not whole:
        placed = placed.where(~F.isnan("__from") & ~F.isnan("__to"))
    # No cell is so narrow that its number doesn't fit: at least the last bits of the range's own ends.
    least = F.lit(1.0) if whole else F.greatest(F.abs("__from"), F.abs("__to"), F.lit(1e-280)) * 2.0**-50
    level = F.ceil(F.log2(F.greatest(width, least))).cast("int")
    cell = lambda at, exponent: F.floor(at.cast("double") / F.pow(F.lit(2.0), exponent))
    celled = placed.withColumn("__level", level).withColumn("__cell", F.explode(F.array_distinct(F.array(*(cell(F.col("__from"), F.col("__level")) + i for i in range(4))))))
    celled = celled.where(F.col("__cell") <= cell(F.col("__to"), F.col("__level")))
    levels = {r["__level"]: r["n"] for r in placed.withColumn("__level", level).groupBy("__level").agg(F.count("*").alias("n")).collect()}
    asked = df.select(F.col(value).alias("__v")).where(F.col(value).isNotNull()).distinct().withColumn("__at", line_position(F.col("__v"), kind))
    if not whole:
        asked = asked.where(~F.isnan("__at"))
    found = None
    few = [n for n, count in levels.items() if count <= FEW_RANGES]
    for some, small in ((few, True), ([n for n in levels if n not in few], False)):
        if not some:
            continue
        probes = asked.withColumn("__level", F.explode(F.array(*map(F.lit, some)))).withColumn("__cell", cell(F.col("__at"), F.col("__level")))
        side = celled.where(F.col("__level").isin(some))
        met = probes.join(F.broadcast(side) if small else side.hint("merge"), ["__level", "__cell"]).where(F.col("__v").between(F.col("__low"), F.col("__high")))
        best = met.groupBy("__v").agg(F.min(F.struct("__priority", "__payload")).alias("__best"))
        found = best if found is None else found.unionByName(best)
    if found is None:
        return df.withColumn(out, F.lit(None).cast(dict(ranges.dtypes)[payload]))
    answers = found.groupBy("__v").agg(F.min("__best").alias("__best")).select("__v", F.col("__best.__payload").alias(out))
    return df.join(answers, F.col(value) == F.col("__v"), "left").drop("__v")


def map_lookup(value: str | Column, mapping: Mapping[str, object], default: object) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    out = F.lit(default)
    for key, found in mapping.items():
        out = F.when(v == key, F.lit(found)).otherwise(out)
    return out
