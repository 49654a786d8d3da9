"""Keys that rows share. An id that two rows carry multiplies rows in every join on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class KeyClashError(ValueError):
    """Rows share a key; ``cases`` holds a sample of (key values, rows)."""

    def __init__(self, table: str, cases: list) -> None:
        super().__init__(f"{table}: rows share a key, such as {cases[:3]}")
        self.cases = cases


def key_violations(df: DataFrame, keys: Sequence[str], out: str = "row_count") -> DataFrame:
    """The key values that more than one row has, and how many have them; null is a value like others.

    Rows are counted by a 64-bit hash first, partly before the shuffle, whatever key is frequent. The few hashes that
    repeat then pick the rows that are counted by their keys, so equal hashes of different keys make no violation; while
    those hashes are small enough for Spark to broadcast, no other key is moved as it is.
    """
    named = [F.col(f"`{k}`") for k in keys]
    hashed = df.select(*named, F.xxhash64(*named).alias("__hash"))
    several = hashed.groupBy("__hash").agg(F.count("*").alias("__rows")).where("__rows > 1").select("__hash")
    likely = hashed.join(several, "__hash", "left_semi")
    return likely.groupBy(*named).agg(F.count("*").alias(out)).where(F.col(out) > 1)


def shared_keys(df: DataFrame, keys: Sequence[str], sample: int = 20) -> list[tuple]:
    """A sample of (key values, rows) of keys that rows share."""
    return [tuple(r) for r in key_violations(df, keys).limit(sample).collect()]


def enforce_unique(df: DataFrame, keys: Sequence[str], table: str, sample: int = 20) -> None:
    """Raise with a sample of the keys that rows share, if there are any."""
    if cases := shared_keys(df, keys, sample):
        raise KeyClashError(table, cases)
