"""Stand-ins for the domain's tables, made of the driver's tables by expressions that both SQL dialects read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the songs stand-in over ``documents`` left-joined with ``labels``.
SONGS = {
    "doc_id": "doc_id",
    "decade": "lang",
    "song_title": "source",
    "sentiment_score": "CASE WHEN quality IS NOT NULL THEN CAST(n_chars % 2001 AS DOUBLE) / 1000 - 1 END",
    "chorus_sentiment_score": "CASE WHEN n_chars % 3 > 0 THEN CAST(n_chars % 1501 AS DOUBLE) / 750 - 1 END",
    "energy_level": "CASE WHEN toxic = 0 THEN n_chars % 5 + 1 END",
    "chorus_detected": "n_chars % 2 = 0",
    "lyrics_quality": "CASE WHEN n_chars >= 600 THEN 'full' WHEN n_chars >= 300 THEN 'partial' ELSE 'missing' END",
    "development_score": "CASE WHEN quality = 1 THEN n_chars % 7 + 1 END",
    "emotional_tone": "CASE n_chars % 5 WHEN 0 THEN 'joy' WHEN 1 THEN 'sadness' WHEN 2 THEN 'anger' WHEN 3 THEN 'fear' END",
    "chorus_emotional_tone": "CASE n_chars % 4 WHEN 0 THEN 'joy' WHEN 1 THEN 'sadness' WHEN 2 THEN 'anger' END",
    "jung_stage": "CASE n_chars % 4 WHEN 0 THEN 'shadow' WHEN 1 THEN 'persona' WHEN 2 THEN 'unclassified' END",
    "themes": "NULLIF(concat_ws('|', CASE WHEN doc_id % 2 = 0 THEN 'love' END, CASE WHEN doc_id % 3 = 0 THEN 'party_celebration' END, CASE WHEN n_chars % 5 < 2 THEN ' struggle ' END, CASE WHEN doc_id % 7 = 1 THEN 'unity' END), '')",
    "chorus_themes": "concat_ws('|', CASE WHEN n_chars % 2 = 0 THEN 'love' END, CASE WHEN n_chars % 3 = 0 THEN 'unity' END)",
}
SONGS_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in SONGS.items()) + " FROM documents LEFT JOIN labels USING (doc_id)"

ENTRIES = {
    "artist": "s_name",
    "title": "CASE WHEN l_linenumber % 2 = 0 THEN upper(p_name) ELSE concat(p_name, ' ') END",
    "rank": "CASE WHEN l_orderkey % 9 > 0 THEN CAST(l_linenumber AS BIGINT) END",
    "weeks": "CAST(l_quantity AS BIGINT)",
    "chart_date": "CAST(l_shipdate AS DATE)",
    "l_orderkey": "l_orderkey",
    "l_linenumber": "l_linenumber",
    "l_partkey": "l_partkey",
    "l_suppkey": "l_suppkey",
}
ENTRIES_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in ENTRIES.items()) + " FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"
ENTRY_ORDER = ("chart_date", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def songs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.selectExpr(*(f"{SONGS[c]} AS {c}" for c in (columns or SONGS)))


def entries(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    joined = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.selectExpr(*(f"{ENTRIES[c]} AS {c}" for c in (columns or ENTRIES)))
