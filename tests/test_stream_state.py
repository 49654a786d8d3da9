"""Keyed state: several batches, restarts, replays and broken parts give what one batch over all rows gives."""

import random

import pytest
from pyspark.sql import functions as F

from moodspark.operators.aggregates import dedupe_canonical
from moodspark.sources.files import folders, remove
from moodspark.streaming import canonical

ENTRY = "title string, artist string, rank long, weeks long, chart_date date, place long"
ORDER = ("chart_date", "place")


@pytest.fixture
def world(spark, tmp_path):
    rng = random.Random(5)
    landing, target, state = (str(tmp_path / n) for n in ("in", "table", "state"))

    def rows(number, count=60):
        made = [
            (rng.choice(["A", "a ", "B", None, "C"]), rng.choice(["x", "X", " y"]), rng.choice([None, 1, 5, 9]), rng.randint(1, 30), f"2000-0{rng.randint(1, 9)}-01", number * 1000 + i)
            for i in range(count)
        ]
        frame = spark.createDataFrame(made, "title string, artist string, rank long, weeks long, d string, place long")
        return frame.select("title", "artist", "rank", "weeks", F.to_date("d").alias("chart_date"), "place")

    def land(number, count=60):
        rows(number, count).coalesce(1).write.mode("append").parquet(landing)

    def take(**options):
        stream = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", 1).parquet(landing)
        canonical.keep_canonical(stream, ORDER, target, state, **options).awaitTermination()

    def same():
        expected = dedupe_canonical(spark.read.schema(ENTRY).parquet(landing), ORDER).collect()
        got = canonical.read_canonical(spark, target).select(*expected[0].asDict()).collect()
        return sorted(map(str, got)) == sorted(map(str, expected))

    return land, take, same, target, state


def test_batches_and_restarts(spark, world):
    land, take, same, target, _ = world
    for number in range(3):
        land(number)
    take(compact_every=2)
    assert same()
    land(3)
    land(4, 1)
    take(compact_every=2)
    assert same()
    # The second snapshot removed what the first covers; the first and what came after it stay.
    assert [n for n in folders(spark, target) if n != "part-4"] == ["part-2", "part-3", "snapshot-1", "snapshot-3"]
    # The last batch touched one key at most.
    assert spark.read.parquet(f"{target}/part-4").count() <= 1
    take(compact_every=2)
    assert same()


def test_half_written_parts_are_replayed(spark, world):
    land, take, same, target, state = world
    land(0)
    land(1)
    take()
    # As a crash leaves it: the last batch's part is incomplete and its commit is missing.
    remove(spark, f"{target}/part-1/_SUCCESS")
    assert canonical.read_canonical(spark, target).count() > 0
    for name in ("1", ".1.crc"):
        remove(spark, f"{state}/commits/{name}")
    take()
    assert same()


def test_lost_state_is_an_error(spark, world):
    land, take, _, target, state = world
    with pytest.raises(FileNotFoundError):
        canonical.read_canonical(spark, target)
    land(0, 5)
    take()
    remove(spark, state)
    with pytest.raises(canonical.StateError):
        take()
