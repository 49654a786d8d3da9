"""Canonical entries kept up to date by keyed state.

What is known of a key (its first spellings in order, best rank, most weeks, first date) is the state of a streaming
aggregation, held in RocksDB on the executors and logged to the query's checkpoint. A batch writes only the keys that it
touched, as a part of its own under its number; every few batches the parts are folded into a snapshot. So the work of a
batch follows its own size, not the table's. A batch that runs again after a failure replaces its part by the same rows.

Parts and snapshots count once they are complete; one that a crash left half-written is ignored by readers and replaced by
the next run. A snapshot removes only what the snapshot before it covers, so a reader that has listed the parts keeps them
until two snapshots later.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodspark.operators.aggregates import dedupe_canonical
from moodspark.sources.files import exists, folders, remove

KEY = "canonical_key"
BATCH = "batch_id"
#: Settings of the store: state on disk, its changes logged batch by batch.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class StateError(RuntimeError):
    """The table was written by a query whose checkpoint is gone."""


def _parts(spark: SparkSession, target: str) -> dict[str, dict[int, str]]:
    """Complete parts and snapshots by the number of their (last) batch."""
    found: dict[str, dict[int, str]] = {"part": {}, "snapshot": {}}
    for name in folders(spark, target):
        kind, _, number = name.partition("-")
        if kind in found and number.isdigit() and exists(spark, f"{target}/{name}/_SUCCESS"):
            found[kind][int(number)] = f"{target}/{name}"
    return found


def _newest(rows: DataFrame) -> DataFrame:
    """Of each key the row of its last batch, which holds all that is known of it."""
    others = [c for c in rows.columns if c != KEY]
    return rows.groupBy(KEY).agg(F.max_by(F.struct(*others), BATCH).alias("newest")).select(KEY, *(f"newest.{c}" for c in others))


def _read(spark: SparkSession, target: str, last: int | None = None) -> DataFrame | None:
    parts = _parts(spark, target)
    base = max((n for n in parts["snapshot"] if last is None or n <= last), default=-1)
    paths = [parts["snapshot"][base]] if base >= 0 else []
    paths += [p for n, p in sorted(parts["part"].items()) if n > base and (last is None or n <= last)]
    return _newest(spark.read.parquet(*paths)) if paths else None


def read_canonical(spark: SparkSession, target: str) -> DataFrame:
    """The table as of its last complete batch; an error where nothing was written."""
    rows = _read(spark, target.rstrip("/"))
    if rows is None:
        raise FileNotFoundError(f"{target} has no complete part")
    return rows.drop(BATCH)


def compact(spark: SparkSession, target: str, last: int) -> None:
    """Fold all parts up to a batch into a snapshot; what the snapshot before covers is removed."""
    before = _parts(spark, target)
    rows = _read(spark, target, last)
    if rows is None:
        return
    rows.write.mode("overwrite").parquet(f"{target}/snapshot-{last}")
    covered = max((n for n in before["snapshot"] if n < last), default=-1)
    for path in [p for n, p in before["part"].items() if n <= covered] + [p for n, p in before["snapshot"].items() if n < covered]:
        remove(spark, path)


def keep_canonical(entries: DataFrame, order: Sequence[str], target: str, checkpoint: str, compact_every: int = 16, **names: str):
    """Start the query that keeps the table at ``target`` for a stream of entries; it handles what is there and stops.

    ``names`` are those of ``dedupe_canonical``. The checkpoint belongs to the table: without it the state is lost, and a
    table that is there already is an error.
    """
    spark, target = entries.sparkSession, target.rstrip("/")
    if folders(spark, target) and not exists(spark, f"{checkpoint}/metadata"):
        raise StateError(f"{target} has parts, but {checkpoint} holds no state of them")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn(BATCH, F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{target}/part-{number}")
        if (number + 1) % compact_every == 0:
            compact(batch.sparkSession, target, number)

    settings = {k: spark.conf.get(k, None) for k in STATE_STORE}
    try:
        for key, value in STATE_STORE.items():
            spark.conf.set(key, value)
        writer = dedupe_canonical(entries, order, **names).writeStream.outputMode("update").foreachBatch(write)
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for key, value in settings.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
