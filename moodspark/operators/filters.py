"""Filters and column shaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_cohort(df: DataFrame, column: str, label: object | None) -> DataFrame:
    """Rows of one cohort; all rows if no label is set or the column is missing."""
    return df if label is None or column not in df.columns else df.where(F.col(column) == label)


def filter_isin(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    return df.where(F.col(column).isin(list(values)))


def filter_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def exclude_label(df: DataFrame, column: str, label: object) -> DataFrame:
    """Rows with another label; rows without one stay."""
    return df.where(~F.col(column).eqNullSafe(label))


def fill_nulls(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items() if c in df.columns})


def with_missing(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add the columns that are missing as nulls of the given types."""
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in df.columns})


def select_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*(c for c in columns if c in df.columns))


def drop_if_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)
