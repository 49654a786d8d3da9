"""Registered queries about keys that rows share, and the latest record of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodspark.operators import keys
from moodspark.plans.catalogue import query, with_songs
from moodspark.plans.proxies import songs, table
from moodspark.sources import files, replylog


@query("key_violations", "SELECT md5(text) AS text_md5, count(*) AS row_count FROM documents GROUP BY text HAVING count(*) > 1")
def key_violations(spark, d):
    """Texts that several documents have."""
    shared = keys.key_violations(table(spark, d, "documents").select("text"), ["text"])
    return shared.select(F.md5(F.col("text").cast("binary")).alias("text_md5"), "row_count")


@query("key_violations_composite", with_songs("SELECT decade, song_title, energy_level, count(*) AS row_count FROM songs GROUP BY ALL HAVING count(*) > 1"))
def key_violations_composite(spark, d):
    """A key of several columns, null among its values."""
    return keys.key_violations(songs(spark, d, "decade", "song_title", "energy_level"), ["decade", "song_title", "energy_level"])


@query(
    "cache_compact",
    """SELECT asked, arg_max(struct_pack(reply := reply), row(reply IS NOT NULL, event_id)).reply AS reply FROM
    (SELECT CAST(user_id AS VARCHAR) AS asked, event_id, CASE WHEN event_id % 3 > 0 THEN event_type END AS reply FROM events) GROUP BY asked""",
)
def cache_compact(spark, d):
    """A log that was appended to three times, compacted to the latest reply to each user."""
    reply = F.when(F.col("event_id") % 3 > 0, F.col("event_type"))
    records = table(spark, d, "events").select(F.col("user_id").cast("string").alias("asked"), reply.alias("reply"), F.timestamp_seconds("event_id").alias("at"), "event_id")
    path = files.scratch(spark, "replies")
    for number in range(3):
        replylog.append(records.where(F.col("event_id") % 3 == number), path)
    replylog.compact(spark, path)
    return spark.read.parquet(path).select("asked", "reply")
