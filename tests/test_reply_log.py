"""The log of replies: a run that stops goes on, equal prompts are asked once, the latest reply counts."""

import datetime

import pytest

from moodspark.sources import replylog
from moodspark.sources.files import listing


def stamp(n):
    return datetime.datetime(2000, 1, 1, 0, 0, n)


def test_latest_reply(spark, tmp_path):
    path = str(tmp_path / "log")
    assert replylog.read_log(spark, path).count() == 0
    for rows in ([("a", "one", stamp(1)), ("b", None, stamp(1))], [("a", "two", stamp(2)), ("b", "late", stamp(0))], [("a", None, stamp(3)), ("c", None, stamp(1))]):
        replylog.append(spark.createDataFrame(rows, replylog.RECORD), path)
    expected = {("a", "two"), ("b", "late"), ("c", None)}
    before = len(listing(spark, path))
    replylog.compact(spark, path)
    assert {(r.asked, r.reply) for r in spark.read.parquet(path).collect()} == expected == {(r.asked, r.reply) for r in replylog.read_log(spark, path).collect()}
    assert len(listing(spark, path)) < before


def test_a_stopped_run_goes_on(spark, tmp_path):
    path, asked = str(tmp_path / "log"), spark.sparkContext.accumulator(0)
    prompts = spark.createDataFrame([(i, f"prompt {i % 38}") for i in range(40)], "batch_id long, prompt string")

    def provider(prompt):
        asked.add(1)
        if prompt == "prompt 3":
            raise OSError("busy")
        return f"reply to {prompt}"

    accept = lambda prompt, reply: True
    real, rounds = replylog.append, []

    def stops(records, target):
        if len(rounds) == 2:
            raise KeyboardInterrupt
        rounds.append(real(records, target))

    replylog.append = stops
    try:
        with pytest.raises(KeyboardInterrupt):
            replylog.ask(prompts, path, provider, per_round=10, accept=accept, tries=1)
    finally:
        replylog.append = real
    done = replylog.read_log(spark, path).count()
    replied = replylog.read_log(spark, path).where("reply IS NOT NULL").count()
    assert 0 < done < 38 and asked.value == done
    got = {r.batch_id: r.reply for r in replylog.ask(prompts, path, provider, per_round=10, accept=accept, tries=1).collect()}
    assert got == {i: None if i % 38 == 3 else f"reply to prompt {i % 38}" for i in range(40)}
    assert asked.value == done + 38 - replied
    # What failed is asked again, nothing else; a log of many files is compacted.
    before = asked.value
    replylog.ask(prompts, path, provider, accept=accept, tries=1, most_files=1)
    assert asked.value == before + 1 and replylog.read_log(spark, path).count() == 38
