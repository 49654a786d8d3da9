"""Registered queries over the driver's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodspark.functions import replies, scores, text
from moodspark.operators import aggregates, filters, index, joins, providers, sections, windows
from moodspark.plans.proxies import ENTRIES_SQL, ENTRY_ORDER, SONGS_SQL, entries, songs, table
from moodspark.plans.schemas import Field, TableSchema
from moodspark.sources import cache, feed, files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

YEARS = (("early", 1995, 1996), ("middle", 1998, 1999), ("late", 2000, 2000), ("shadowed", 1999, 2000))
LANGS = ("en", "fr", "de", "es")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its oracle if SQL can express it."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def with_songs(sql: str) -> str:
    """SQL over the songs stand-in; it may begin with more common tables after a comma."""
    return f"WITH songs AS ({SONGS_SQL}){sql}" if sql.startswith(",") else f"WITH songs AS ({SONGS_SQL}) {sql}"


def with_entries(sql: str) -> str:
    return f"WITH entries AS ({ENTRIES_SQL}) {sql}"


# Sources.


@query(
    "explode_weekly_feed",
    """SELECT CAST(first AS DATE) AS chart_date, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS INTEGER) AS position,
    trim(p_name) AS title, trim(s_name) AS artist, CAST(l_linenumber AS BIGINT) AS rank, CAST(l_quantity AS BIGINT) AS weeks
    FROM (SELECT *, min(l_shipdate) OVER (PARTITION BY l_orderkey) AS first FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)
    QUALIFY l_linenumber <> 3""",
)
def explode_weekly_feed(spark, d):
    rows = entries(spark, d, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "chart_date", "weeks").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    # A week is an order here, so a week's list is short; the third entry's title is blank and goes.
    entry = F.struct(F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.when(F.col("l_linenumber") == 3, " ").otherwise(F.col("p_name")).alias("song"), F.col("s_name").alias("artist"), F.col("l_linenumber").cast("long").alias("peak_position"), F.col("weeks").alias("weeks_on_chart"))
    weeks = rows.groupBy("l_orderkey").agg(F.min("chart_date").cast("string").alias("date"), F.array_sort(F.collect_list(entry)).alias("data"))
    return feed.explode_weekly_feed(weeks)


@query("week_calendar", "SELECT CAST(d AS DATE) AS week FROM generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY) t(d) WHERE dayofweek(d) = 6")
def week_calendar(spark, d):
    return feed.week_calendar(spark, 1995, 2001)


@query("union_weeks", "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS chart_date FROM lineitem")
def union_weeks(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("chart_date"))
    return feed.union_weeks(lines.where("l_linenumber <= 2"), lines.where("l_linenumber > 2"))


@query(
    "feed_coverage",
    """WITH c AS (SELECT CAST(d AS DATE) AS week FROM generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY) t(d) WHERE dayofweek(d) = 6),
    l AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS week FROM lineitem)
    SELECT count(*) AS expected, count(l.week) AS fetched, avg(CASE WHEN l.week IS NULL THEN 0.0 ELSE 1.0 END) AS coverage FROM c LEFT JOIN l ON c.week = l.week""",
)
def feed_coverage(spark, d):
    return feed.feed_coverage(feed.week_calendar(spark, 1995, 2001), table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("chart_date")))


@query("cache_hits", "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def cache_hits(spark, d):
    return cache.cache_hits(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@query("cache_misses", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def cache_misses(spark, d):
    return cache.cache_misses(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id"), "doc_id")


EVENT_SQL = "SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, event_type, value FROM events"
EVENTS = "event_id long, user_id string, event_type string, value double"


def event_rows(spark, d):
    return table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("user_id"), "event_type", "value")


@query("csv_round_trip", EVENT_SQL)
def csv_round_trip(spark, d):
    """Written with every field quoted and read with a schema, so that ids of digits stay text."""
    files.write_csv(event_rows(spark, d), path := files.scratch(spark, "csv"), quote_all=True)
    return files.read_csv(spark, path, EVENTS)


@query("csv_inferred", "SELECT CAST(event_id AS BIGINT) AS event_id, CAST(user_id AS VARCHAR) AS user_id, event_type, value FROM events")
def csv_inferred(spark, d):
    """Types from the rows themselves, but for an id that is pinned to text."""
    files.write_csv(event_rows(spark, d), path := files.scratch(spark, "csv"))
    return files.read_csv(spark, path, text=["user_id"]).withColumn("event_id", F.col("event_id").cast("long"))


@query("column_pruned_scan", "SELECT l_orderkey, l_quantity FROM lineitem")
def column_pruned_scan(spark, d):
    return files.read_columns(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_quantity"])


@query("optional_source", "SELECT doc_id, quality FROM labels")
def optional_source(spark, d):
    """A table that is there and one that isn't, which adds no rows."""
    there, absent = (files.read_optional(spark, f"{d}/{name}.parquet", "doc_id long, quality int") for name in ("labels", "no_such_table"))
    return there.select("doc_id", "quality").unionByName(absent)


@query("required_source", "SELECT r_regionkey, r_name FROM region")
def required_source(spark, d):
    return spark.read.parquet(files.require_path(spark, f"{d}/region.parquet", "the driver")).select("r_regionkey", "r_name")


@query("atomic_sink", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def atomic_sink(spark, d):
    """A second write takes the place of the first; what its check gives is what stays."""
    rows, path = table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), files.scratch(spark, "atomic")
    files.write_atomic(rows, path)
    files.write_atomic(rows, path, check=lambda written: written.where("o_orderstatus <> 'F'"))
    return spark.read.parquet(path)


@query("cache_latest", "SELECT CAST(doc_id AS VARCHAR) AS song_id, CASE WHEN doc_id % 3 > 0 THEN lang END AS lyrics, CASE WHEN doc_id % 3 > 0 THEN 'found' ELSE 'missing' END AS status FROM documents")
def cache_latest(spark, d):
    """A cache of files filled by look-ups: records of files stay, the others are looked up once."""
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("song_id"), F.col("lang").alias("song_title"), F.col("doc_id").cast("string").alias("artist"))
    path = files.scratch(spark, "texts")
    known = rows.where("artist % 3 = 1").select("song_id", F.col("song_title").alias("lyrics"), F.lit("found").alias("status"))
    known.write.parquet(cache.fetched_path(path))
    cache.fill(rows, path, lambda title, artist: title if int(artist) % 3 else None, tries=1, pause=0)
    return cache.fill(rows, path, lambda title, artist: "asked twice", tries=1, pause=0)


# Filters and projections.


@query("select_present", "SELECT doc_id, lang FROM documents")
def select_present(spark, d):
    return filters.select_present(table(spark, d, "documents"), ["doc_id", "no_such_column", "lang"])


@query("drop_if_present", "SELECT doc_id, lang, source FROM documents")
def drop_if_present(spark, d):
    return filters.drop_if_present(table(spark, d, "documents"), ["text", "n_chars", "no_such_column"])


@query("drop_without_bucket", "SELECT o_orderkey, CASE WHEN year(o_orderdate) BETWEEN 1995 AND 1996 THEN 'early' ELSE 'middle' END AS bucket FROM orders WHERE year(o_orderdate) IN (1995, 1996, 1998, 1999)")
def drop_without_bucket(spark, d):
    placed = table(spark, d, "orders").select("o_orderkey", joins.range_bucket_case(F.year("o_orderdate"), YEARS[:2]).alias("bucket"))
    return filters.filter_not_null(placed, ["bucket"])


@query("model_input", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE source END AS given FROM documents")
def model_input(spark, d):
    blank = F.when(F.col("doc_id") % 3 == 0, F.when(F.col("doc_id") % 2 == 0, "  ")).otherwise(F.col("source"))
    return table(spark, d, "documents").select("doc_id", text.model_input(blank).alias("given"))


@query("filter_cohort", "SELECT doc_id, lang FROM documents WHERE lang = 'fr'")
def filter_cohort(spark, d):
    return filters.filter_cohort(table(spark, d, "documents").select("doc_id", "lang"), "lang", "fr")


@query("filter_isin", "SELECT doc_id, lang FROM documents WHERE lang IN ('fr', 'de')")
def filter_isin(spark, d):
    return filters.filter_isin(table(spark, d, "documents").select("doc_id", "lang"), "lang", ["fr", "de"])


@query("filter_not_null", with_songs("SELECT doc_id, emotional_tone, energy_level FROM songs WHERE emotional_tone IS NOT NULL AND energy_level IS NOT NULL"))
def filter_not_null(spark, d):
    return filters.filter_not_null(songs(spark, d, "doc_id", "emotional_tone", "energy_level"), ["emotional_tone", "energy_level"])


@query("exclude_label", with_songs("SELECT doc_id, jung_stage FROM songs WHERE jung_stage IS DISTINCT FROM 'unclassified'"))
def exclude_label(spark, d):
    return filters.exclude_label(songs(spark, d, "doc_id", "jung_stage"), "jung_stage", "unclassified")


@query("fill_nulls", with_songs("SELECT doc_id, coalesce(emotional_tone, 'none') AS emotional_tone, coalesce(energy_level, 0) AS energy_level FROM songs"))
def fill_nulls(spark, d):
    return filters.fill_nulls(songs(spark, d, "doc_id", "emotional_tone", "energy_level"), {"emotional_tone": "none", "energy_level": 0})


@query("with_missing", "SELECT doc_id, lang, CAST(NULL AS DOUBLE) AS sentiment_score FROM documents")
def with_missing(spark, d):
    return filters.with_missing(table(spark, d, "documents").select("doc_id", "lang"), {"lang": "string", "sentiment_score": "double"})


@query("numeric_coerce", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN CAST(user_id AS VARCHAR) END AS DOUBLE) AS coerced FROM events")
def numeric_coerce(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).when(F.col("event_id") % 3 == 1, F.col("user_id").cast("string"))
    return table(spark, d, "events").select("event_id", scores.numeric_coerce(raw).alias("coerced"))


@query("coalesce_nonblank", "SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN source WHEN doc_id % 2 = 0 THEN lang END AS chosen FROM documents")
def coalesce_nonblank(spark, d):
    first = F.when(F.col("doc_id") % 3 > 0, F.col("source")).otherwise("  \t")
    second = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("")
    return table(spark, d, "documents").select("doc_id", text.coalesce_nonblank(first, second).alias("chosen"))


@query("scored_unless_missing", with_songs("SELECT doc_id, CASE WHEN lyrics_quality <> 'missing' THEN sentiment_score END AS scored FROM songs"))
def scored_unless_missing(spark, d):
    return songs(spark, d, "doc_id", "lyrics_quality", "sentiment_score").select("doc_id", scores.scored_unless_missing("lyrics_quality", "sentiment_score").alias("scored"))


# Joins and lookups.


@query(
    "left_join_layers",
    "SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic, e.n_chars AS n_chars_evt, e.user_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN (SELECT event_id AS doc_id, user_id AS n_chars, user_id FROM events) e ON d.doc_id = e.doc_id",
)
def left_join_layers(spark, d):
    layers = [(table(spark, d, "labels"), "_lab"), (table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.col("user_id").alias("n_chars"), "user_id"), "_evt")]
    return joins.left_join_layers(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), layers, "doc_id")


@query("left_join_suffix", "SELECT o.o_orderkey, o.o_orderstatus, l.n AS n, l.o_orderstatus AS o_orderstatus_agg FROM orders o LEFT JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n, max(l_returnflag) AS o_orderstatus FROM lineitem GROUP BY 1) l ON o.o_orderkey = l.o_orderkey")
def left_join_suffix(spark, d):
    layer = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.max("l_returnflag").alias("o_orderstatus"))
    return joins.left_join_suffix(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), layer, "o_orderkey", "_agg")


@query("left_join_pruned", "SELECT d.doc_id, d.lang, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_join_pruned(spark, d):
    return joins.left_join_pruned(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id", ["toxic"])


@query("join_replace", "SELECT d.doc_id, d.lang, coalesce(CAST(l.quality AS BIGINT), 0) AS n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_replace(spark, d):
    right = table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("n_chars"))
    return joins.join_replace(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), right, "doc_id", {"n_chars": 0})


BUCKET_SQL = "SELECT o_orderkey, CASE WHEN year(o_orderdate) BETWEEN 1995 AND 1996 THEN 'early' WHEN year(o_orderdate) BETWEEN 1998 AND 1999 THEN 'middle' WHEN year(o_orderdate) = 2000 THEN 'late' END AS bucket FROM orders"


@query("range_bucket_case", BUCKET_SQL)
def range_bucket_case(spark, d):
    return table(spark, d, "orders").select("o_orderkey", joins.range_bucket_case(F.year("o_orderdate"), YEARS).alias("bucket"))


@query("range_bucket_join", BUCKET_SQL)
def range_bucket_join(spark, d):
    return joins.range_bucket_join(table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y")), "y", YEARS).select("o_orderkey", "bucket")


@query(
    "range_lookup",
    """WITH r AS (SELECT o_orderkey, o_custkey * 1000000000 + o_orderkey AS place, CAST(o_orderdate AS DATE) AS low, CAST(o_orderdate AS DATE) + CAST(CASE WHEN o_orderkey % 40 = 0 THEN 400 ELSE o_orderkey % 5 END AS INTEGER) AS high FROM orders),
    v AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS v FROM lineitem),
    b AS (SELECT v, arg_min(o_orderkey, place) AS first_order FROM v JOIN r ON v BETWEEN low AND high GROUP BY 1)
    SELECT l_orderkey, l_linenumber, first_order FROM lineitem LEFT JOIN b ON CAST(l_shipdate AS DATE) = v""",
)
def range_lookup(spark, d):
    """The first order, by customer, in whose days a line was shipped; one order in forty has 400 days, the others up to five."""
    day = F.to_date("o_orderdate")
    days = F.when(F.col("o_orderkey") % 40 == 0, 400).otherwise(F.col("o_orderkey") % 5).cast("int")
    orders = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") * 1000000000 + F.col("o_orderkey")).alias("place"), day.alias("low"), F.date_add(day, days).alias("high"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("shipped"))
    return joins.interval_lookup(lines, "shipped", orders, "low", "high", "o_orderkey", "place", "first_order").drop("shipped")


@query("map_lookup", "SELECT doc_id, CASE lang WHEN 'en' THEN 1.0::DOUBLE WHEN 'fr' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS looked_up FROM documents")
def map_lookup(spark, d):
    return table(spark, d, "documents").select("doc_id", joins.map_lookup("lang", {"en": 1.0, "fr": 0.5}, 0.0).alias("looked_up"))


RECONCILE_SQL = """WITH req AS (SELECT doc_id // 5 AS batch_id, CAST(doc_id AS VARCHAR) AS song_id FROM documents),
rec AS (SELECT batch_id, song_id, CASE WHEN CAST(song_id AS BIGINT) % 3 = 0 THEN 'persona' ELSE 'shadow' END AS jung_stage, CAST(song_id AS BIGINT) % 7 + 1 AS development_score FROM req WHERE CAST(song_id AS BIGINT) % 40 <> 7),
met AS (SELECT q.batch_id, q.song_id, r.jung_stage, r.development_score, r.song_id IS NOT NULL AS found FROM req q LEFT JOIN rec r ON q.batch_id = r.batch_id AND q.song_id = r.song_id),
whole AS (SELECT *, bool_and(found) OVER (PARTITION BY batch_id) AS complete FROM met)
SELECT batch_id, song_id, complete, CASE WHEN complete THEN jung_stage END AS jung_stage, CAST(NULL AS VARCHAR) AS psychological_theme, CASE WHEN complete THEN development_score END AS development_score FROM whole"""


@query("batch_reconcile", RECONCILE_SQL)
def batch_reconcile(spark, d):
    requested = table(spark, d, "documents").select(F.expr("doc_id div 5").alias("batch_id"), F.col("doc_id").cast("string").alias("song_id"))
    number = F.col("song_id").cast("long")
    # Every id answers twice: the later answer counts.
    record = lambda p, stage: requested.where(number % 40 != 7).select("batch_id", "song_id", F.lit(p).alias("position"), stage.alias("jung_stage"), F.lit(None).cast("string").alias("psychological_theme"), (number % 7 + p).alias("development_score"))
    records = record(0, F.lit("transcendence")).unionByName(record(1, F.when(number % 3 == 0, "persona").otherwise("shadow")))
    return replies.reconcile(requested, records)


# Aggregates.


@query(
    "dedupe_canonical",
    with_entries(
        """SELECT lower(trim(artist)) || '||' || lower(trim(title)) AS canonical_key, arg_min(title, row(chart_date, l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS title,
    arg_min(artist, row(chart_date, l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS artist, min(rank) AS chart_rank, max(weeks) AS chart_weeks_on, min(chart_date) AS first_chart_date FROM entries GROUP BY 1"""
    ),
)
def dedupe_canonical(spark, d):
    return aggregates.dedupe_canonical(entries(spark, d), ENTRY_ORDER)


@query("cohort_counts", with_songs("SELECT decade, count(*) AS row_count, count(sentiment_score) AS sentiment_score_count FROM songs GROUP BY decade"))
def cohort_counts(spark, d):
    return aggregates.cohort_counts(songs(spark, d, "decade", "sentiment_score"), "decade", "sentiment_score")


@query("cohort_mean", with_songs("SELECT decade, round(avg(sentiment_score), 6) AS mean_value FROM songs GROUP BY decade"))
def cohort_mean(spark, d):
    return aggregates.cohort_mean(songs(spark, d, "decade", "sentiment_score"), "decade", "sentiment_score").withColumn("mean_value", F.round("mean_value", 6))


def mode_sql(column: str, condition: str, out: str) -> str:
    return with_songs(f"SELECT c.decade, m.v AS {out} FROM (SELECT DISTINCT decade FROM songs) c LEFT JOIN (SELECT decade, {column} AS v FROM songs WHERE {condition} GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY decade ORDER BY count(*) DESC, {column}) = 1) m ON c.decade = m.decade")


@query("cohort_mode", mode_sql("emotional_tone", "emotional_tone IS NOT NULL", "tone"))
def cohort_mode(spark, d):
    return songs(spark, d, "decade", "emotional_tone").groupBy("decade").agg(aggregates.mode_value("emotional_tone").alias("tone"))


@query("cohort_mode_excluding", mode_sql("jung_stage", "jung_stage <> 'unclassified'", "stage"))
def cohort_mode_excluding(spark, d):
    return songs(spark, d, "decade", "jung_stage").groupBy("decade").agg(aggregates.mode_excluding("jung_stage", "unclassified").alias("stage"))


TAGS_SQL = "tags AS (SELECT decade, doc_id, pos, trim(t) AS tag FROM (SELECT decade, doc_id, unnest(string_split(themes, '|')) AS t, generate_subscripts(string_split(themes, '|'), 1) AS pos FROM songs) WHERE trim(t) <> '')"
TOP_TAGS_SQL = "ranked AS (SELECT decade, tag, row_number() OVER (PARTITION BY decade ORDER BY count(*) DESC, min(row(doc_id, pos))) AS r FROM tags GROUP BY 1, 2)"


@query("top_tags", with_songs(f", {TAGS_SQL}, {TOP_TAGS_SQL} SELECT decade, string_agg(tag, '|' ORDER BY r) AS top_tags FROM ranked WHERE r <= 3 GROUP BY decade"))
def top_tags(spark, d):
    return aggregates.top_tags(songs(spark, d, "doc_id", "decade", "themes"), "decade", "themes", ["doc_id"], 3)


@query("top_titles", with_songs("SELECT decade, string_agg(song_title, '|' ORDER BY r) AS top_titles FROM (SELECT decade, song_title, row_number() OVER (PARTITION BY decade ORDER BY sentiment_score DESC, doc_id) AS r FROM songs WHERE sentiment_score IS NOT NULL) WHERE r <= 3 GROUP BY decade"))
def top_titles(spark, d):
    return aggregates.top_titles(songs(spark, d, "doc_id", "decade", "song_title", "sentiment_score"), "decade", "song_title", "sentiment_score", ["doc_id"], 3)


IMPUTED_SQL = "imputed AS (SELECT * REPLACE (CASE WHEN decade IS NOT NULL THEN coalesce(sentiment_score, avg(sentiment_score) OVER w) END AS sentiment_score, CASE WHEN decade IS NOT NULL THEN coalesce(CAST(energy_level AS DOUBLE), avg(energy_level) OVER w) END AS energy_level, CASE WHEN decade IS NOT NULL THEN coalesce(CAST(development_score AS DOUBLE), avg(development_score) OVER w) END AS development_score) FROM songs WINDOW w AS (PARTITION BY decade))"
RESONANCE_SQL = """round(least(greatest(0.25 * (least(greatest(sentiment_score, -1.0), 1.0) + 1) / 2 + 0.20 * (least(greatest(CAST(energy_level AS DOUBLE), 1.0), 5.0) - 1) / 4 + 0.15 * CASE WHEN chorus_detected THEN 1 ELSE 0 END
+ 0.20 * CASE lyrics_quality WHEN 'full' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END + 0.20 * (least(greatest(CAST(development_score AS DOUBLE), 1.0), 7.0) - 1) / 6 + CASE WHEN sentiment_score IS NULL OR energy_level IS NULL OR development_score IS NULL THEN NULL ELSE 0 END, 0.0), 1.0), 6)"""


@query(
    "cohort_mood_index",
    with_songs(
        f""", {IMPUTED_SQL}, scored AS (SELECT *, CASE WHEN sentiment_score IS NULL OR energy_level IS NULL OR development_score IS NULL THEN NULL ELSE {RESONANCE_SQL} END AS score FROM imputed WHERE decade IS NOT NULL), {TAGS_SQL}, {TOP_TAGS_SQL},
    tops AS (SELECT decade, string_agg(tag, '|' ORDER BY r) AS top_themes FROM ranked WHERE r <= 5 GROUP BY decade),
    titles AS (SELECT decade, string_agg(song_title, '|' ORDER BY r) AS top_resonance_songs FROM (SELECT decade, song_title, row_number() OVER (PARTITION BY decade ORDER BY score DESC, doc_id) AS r FROM scored WHERE score IS NOT NULL) WHERE r <= 3 GROUP BY decade),
    tones AS (SELECT decade, emotional_tone FROM songs WHERE emotional_tone IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY decade ORDER BY count(*) DESC, emotional_tone) = 1),
    stages AS (SELECT decade, jung_stage FROM songs WHERE jung_stage <> 'unclassified' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY decade ORDER BY count(*) DESC, jung_stage) = 1)
    SELECT s.decade AS decade_label, count(*) AS song_count, count(score) AS scored_count, round(avg(sentiment_score), 6) AS CMI_sentiment, round(avg(energy_level), 6) AS CMI_energy,
    any_value(t.emotional_tone) AS emotional_tone, any_value(g.jung_stage) AS dominant_jung_stage, any_value(o.top_themes) AS top_themes, any_value(i.top_resonance_songs) AS top_resonance_songs
    FROM scored s LEFT JOIN tones t ON s.decade = t.decade LEFT JOIN stages g ON s.decade = g.decade LEFT JOIN tops o ON s.decade = o.decade LEFT JOIN titles i ON s.decade = i.decade GROUP BY s.decade"""
    ),
)
def cohort_mood_index(spark, d):
    return index.cohort_mood_index(index.with_resonance(songs(spark, d)), ["doc_id"]).withColumns({"CMI_sentiment": F.round("CMI_sentiment", 6), "CMI_energy": F.round("CMI_energy", 6)})


@query("coverage_rate", with_songs("SELECT decade, round(coalesce(count(*) FILTER (lyrics_quality = 'full' AND sentiment_score IS NOT NULL) / nullif(count(*) FILTER (lyrics_quality = 'full'), 0), 1.0), 6) AS coverage FROM songs GROUP BY decade"))
def coverage_rate(spark, d):
    return songs(spark, d, "decade", "lyrics_quality", "sentiment_score").groupBy("decade").agg(F.round(aggregates.coverage_rate("lyrics_quality", "sentiment_score"), 6).alias("coverage"))


@query("nonnull_fraction", with_songs("SELECT decade, round(avg(CASE WHEN energy_level IS NULL THEN 0.0 ELSE 1.0 END), 6) AS known FROM songs GROUP BY decade"))
def nonnull_fraction(spark, d):
    return songs(spark, d, "decade", "energy_level").groupBy("decade").agg(F.round(aggregates.nonnull_fraction("energy_level"), 6).alias("known"))


@query("value_counts", with_songs("SELECT emotional_tone, count(*) AS n FROM songs WHERE emotional_tone IS NOT NULL GROUP BY 1"))
def value_counts(spark, d):
    return aggregates.value_counts(songs(spark, d, "emotional_tone"), "emotional_tone")


@query("label_share", with_songs("SELECT decade, emotional_tone, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY decade) * 1000) / 10 AS pct FROM songs WHERE emotional_tone IN ('joy', 'anger', 'fear') GROUP BY 1, 2"))
def label_share(spark, d):
    return aggregates.label_share(songs(spark, d, "decade", "emotional_tone"), "decade", "emotional_tone", ["joy", "anger", "fear"])


PENETRATION_SQL = f", {TAGS_SQL}, sizes AS (SELECT decade, count(*) AS n FROM songs GROUP BY 1), pen AS (SELECT t.decade, tag, round(count(*) / any_value(s.n) * 100, 6) AS pct FROM tags t JOIN sizes s ON t.decade = s.decade GROUP BY 1, 2)"


@query("tag_penetration", with_songs(f"{PENETRATION_SQL} SELECT decade, tag, pct FROM pen"))
def tag_penetration(spark, d):
    return aggregates.tag_penetration(songs(spark, d, "decade", "themes"), "decade", "themes").withColumn("pct", F.round("pct", 6))


@query("tag_penetration_pivot", with_songs(f"{PENETRATION_SQL} SELECT tag, " + ", ".join(f"coalesce(max(CASE WHEN decade = '{c}' THEN pct END), 0.0) AS {c}" for c in LANGS) + " FROM pen GROUP BY tag"))
def tag_penetration_pivot(spark, d):
    wide = aggregates.tag_penetration_pivot(songs(spark, d, "decade", "themes"), "decade", "themes", LANGS)
    return wide.select("tag", *(F.round(c, 6).alias(c) for c in LANGS))


@query(
    "distribution_summary",
    """SELECT event_type, p[1] AS low, p[2] AS q1, p[3] AS median, p[4] AS q3, p[5] AS high, round(p[2] - 1.5 * (p[4] - p[2]), 6) AS lower_fence, round(p[4] + 1.5 * (p[4] - p[2]), 6) AS upper_fence
    FROM (SELECT event_type, list_transform(quantile_cont(value, [0, 0.25, 0.5, 0.75, 1]), lambda x: round(x, 6)) AS p FROM events GROUP BY 1)""",
)
def distribution_summary(spark, d):
    out = aggregates.distribution_summary(table(spark, d, "events").select("event_type", "value"), "event_type", "value")
    return out.select("event_type", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@query(
    "distribution_outliers",
    """WITH q AS (SELECT l_returnflag, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM (SELECT l_returnflag, CAST(l_extendedprice * l_quantity AS DOUBLE) AS v FROM lineitem) GROUP BY 1),
    f AS (SELECT l_orderkey, l_linenumber, l_returnflag, CAST(l_extendedprice * l_quantity AS DOUBLE) AS v, a - 1.5 * (b - a) AS low, b + 1.5 * (b - a) AS high FROM lineitem JOIN q USING (l_returnflag)),
    w AS (SELECT l_returnflag, min(v) AS whisker_low, max(v) AS whisker_high FROM f WHERE v BETWEEN low AND high GROUP BY 1)
    SELECT l_orderkey, l_linenumber, l_returnflag, round(v, 4) AS amount, CASE WHEN v < low THEN 'low' ELSE 'high' END AS side, round(whisker_low, 4) AS whisker_low, round(whisker_high, 4) AS whisker_high FROM f JOIN w USING (l_returnflag) WHERE v < low OR v > high""",
)
def distribution_outliers(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_extendedprice") * F.col("l_quantity")).cast("double").alias("amount"))
    out = aggregates.distribution_outliers(lines, "l_returnflag", "amount")
    return out.withColumns({c: F.round(c, 4) for c in ("amount", "whisker_low", "whisker_high")})


@query("argmax_cohort", with_songs("SELECT arg_max(decade, m) AS decade FROM (SELECT decade, count(sentiment_score) AS m FROM songs GROUP BY 1)"))
def argmax_cohort(spark, d):
    counted = songs(spark, d, "decade", "sentiment_score").groupBy("decade").agg(F.count("sentiment_score").alias("m"))
    return aggregates.extreme_cohort(counted.withColumn("place", windows.canonical_place("decade", LANGS)), "decade", "m", "place")


@query("argmin_cohort", with_songs("SELECT decade FROM (SELECT decade, round(avg(sentiment_score), 6) AS m FROM songs GROUP BY 1) ORDER BY m, decade LIMIT 1"))
def argmin_cohort(spark, d):
    means = songs(spark, d, "decade", "sentiment_score").groupBy("decade").agg(F.round(F.avg("sentiment_score"), 6).alias("m"))
    return aggregates.extreme_cohort(means.withColumn("place", windows.canonical_place("decade", sorted(LANGS))), "decade", "m", "place", largest=False)


@query("label_distribution", "SELECT source, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents) * 100, 6) AS pct FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY n DESC, source LIMIT 6")
def label_distribution(spark, d):
    return aggregates.label_distribution(table(spark, d, "documents").select("source"), "source").withColumn("pct", F.round("pct", 6))


@query("conditional_counts", with_songs("SELECT decade, count(*) FILTER (jung_stage = 'unclassified') AS unclassified, count(*) FILTER (jung_stage <> 'unclassified') AS classified, count(*) FILTER (jung_stage <> 'unclassified' AND development_score IS NOT NULL) AS high FROM songs GROUP BY decade"))
def conditional_counts(spark, d):
    stage, known = F.col("jung_stage"), F.col("development_score").isNotNull()
    counts = aggregates.conditional_counts({"unclassified": stage == "unclassified", "classified": stage != "unclassified", "high": (stage != "unclassified") & known})
    return songs(spark, d, "decade", "jung_stage", "development_score").groupBy("decade").agg(*counts)


@query("global_totals", with_songs("SELECT count(*) AS songs, count(sentiment_score) AS scored, sum(CASE WHEN chorus_detected THEN 1 ELSE 0 END)::BIGINT AS choruses FROM songs"))
def global_totals(spark, d):
    return songs(spark, d, "sentiment_score", "chorus_detected").agg(F.count("*").alias("songs"), F.count("sentiment_score").alias("scored"), F.sum(F.col("chorus_detected").cast("long")).alias("choruses"))


# Windows and order.


IMPUTE_SQL = with_songs(f", {IMPUTED_SQL} SELECT doc_id, decade, round(sentiment_score, 6) AS sentiment_score, round(energy_level, 6) AS energy_level, round(development_score, 6) AS development_score FROM imputed")


def imputed(spark, d, by_window):
    rows = songs(spark, d, "doc_id", "decade", *index.COMPONENTS)
    out = windows.impute_cohort_mean(rows, "decade", index.COMPONENTS, by_window)
    return out.select("doc_id", "decade", *(F.round(c, 6).alias(c) for c in index.COMPONENTS))


@query("impute_cohort_mean", IMPUTE_SQL)
def impute_cohort_mean(spark, d):
    return imputed(spark, d, False)


@query("impute_cohort_mean_window", IMPUTE_SQL)
def impute_cohort_mean_window(spark, d):
    return imputed(spark, d, True)


@query("batch_assign", "SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 5) AS BIGINT) AS batch_id FROM documents")
def batch_assign(spark, d):
    return windows.batch_assign(table(spark, d, "documents").select("doc_id"), 5, ["doc_id"])


@query("batch_assign_by_cohort", "SELECT doc_id, lang, CAST(floor((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) / 8) AS BIGINT) AS batch_id FROM documents")
def batch_assign_by_cohort(spark, d):
    return windows.batch_assign(table(spark, d, "documents").select("doc_id", "lang"), 8, ["doc_id"], part="lang")


@query("canonical_sort", "SELECT doc_id, lang, CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 999 END::BIGINT AS place FROM documents ORDER BY place, lang, doc_id")
def canonical_sort(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").withColumn("place", windows.canonical_place("lang", ("fr", "en")))
    return windows.canonical_sort(rows, "lang", ("fr", "en"), ("doc_id",))


@query("ordered_labels", "SELECT DISTINCT lang, CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 999 END::BIGINT AS place FROM documents")
def ordered_labels(spark, d):
    return windows.ordered_labels(table(spark, d, "documents").select("lang"), "lang", ("fr", "en"))


# Sets and tags.


CHORUS_SETS = with_songs("SELECT doc_id, {} FROM (SELECT doc_id, list_filter(list_transform(string_split(coalesce(themes, ''), '|'), lambda x: trim(x)), lambda x: x <> '') AS a, list_filter(string_split(chorus_themes, '|'), lambda x: x <> '') AS b FROM songs)")
DISTANCE_SQL = "CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0 ELSE round(1 - len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 4) END"


def theme_distance(spark, d):
    rows = songs(spark, d, "doc_id", "themes", "chorus_themes")
    return rows.select("doc_id", scores.jaccard_distance(text.split_tags(F.coalesce("themes", F.lit(""))), text.split_tags("chorus_themes")).alias("distance"))


@query("jaccard_distance", CHORUS_SETS.format(f"{DISTANCE_SQL} AS distance"))
def jaccard_distance(spark, d):
    return theme_distance(spark, d)


@query("jaccard_bucket", CHORUS_SETS.format(f"CASE WHEN {DISTANCE_SQL} = 0 THEN 'none' WHEN {DISTANCE_SQL} <= 0.5 THEN 'minor' ELSE 'major' END AS shift"))
def jaccard_bucket(spark, d):
    return theme_distance(spark, d).select("doc_id", scores.jaccard_bucket("distance").alias("shift"))


@query("split_tags", with_songs("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(themes, '|'), lambda x: trim(x)), lambda x: x <> ''), ',') AS tags FROM songs"))
def split_tags(spark, d):
    return songs(spark, d, "doc_id", "themes").select("doc_id", F.array_join(text.split_tags("themes"), ",").alias("tags"))


# Texts.


@query("normalise_spacing", r"SELECT doc_id, trim(regexp_replace('  ' || text || chr(9), '\s+', ' ', 'g')) AS spaced FROM documents")
def normalise_spacing(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalise_spacing(F.concat(F.lit("  "), "text", F.lit("\t"))).alias("spaced"))


NORM_SQL = r"trim(regexp_replace(regexp_replace(lower(trim({})), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("entity_id", f"SELECT p_partkey, left(md5({NORM_SQL.format('p_brand')} || '|' || {NORM_SQL.format('p_name')} || '|' || CAST(1958 + p_size AS VARCHAR)), 16) AS song_id FROM part")
def entity_id(spark, d):
    return table(spark, d, "part").select("p_partkey", text.entity_id("p_brand", "p_name", F.lit(1958) + F.col("p_size")).alias("song_id"))


@query("validate_id", "SELECT doc_id, regexp_full_match(CASE WHEN doc_id % 2 = 0 THEN left(md5(source), 16) WHEN doc_id % 3 = 0 THEN left(md5(source), 15) ELSE upper(left(md5(source), 16)) || 'G' END, '[0-9a-f]{16}') AS valid FROM documents")
def validate_id(spark, d):
    digest = F.md5("source")
    made = F.when(F.col("doc_id") % 2 == 0, F.substring(digest, 1, 16)).when(F.col("doc_id") % 3 == 0, F.substring(digest, 1, 15)).otherwise(F.concat(F.upper(F.substring(digest, 1, 16)), F.lit("G")))
    return table(spark, d, "documents").select("doc_id", text.is_entity_id(made).alias("valid"))


@query("strip_header", r"SELECT doc_id, regexp_replace(CASE WHEN doc_id % 3 < 2 THEN text ELSE 'one' || chr(10) || text END, '^\s+|\s+$', '', 'g') AS body FROM documents")
def strip_header(spark, d):
    head = F.when(F.col("doc_id") % 3 == 0, "a title Lyrics\n").when(F.col("doc_id") % 3 == 1, "3 Contributors\n").otherwise("one\n")
    return table(spark, d, "documents").select("doc_id", text.strip_header(F.concat(head, "text")).alias("body"))


def tagged(spark, d):
    """Documents as tagged texts, whole."""
    whole = F.concat(F.lit("[Verse 1]\n  “"), "text", F.lit("” \n\n[Chorus]\n"), F.col("source"), F.lit("   sings along\n12 Embed\nSee Anybody Live\n[Verse 2]\nonce more—"), F.col("lang"))
    return table(spark, d, "documents").select("doc_id", whole.alias("raw"))


TAGGED_SQL = "SELECT doc_id, '[Verse 1]' || chr(10) || '  “' || text || '” ' || chr(10) || chr(10) || '[Chorus]' || chr(10) || source || '   sings along' || chr(10) || '12 Embed' || chr(10) || 'See Anybody Live' || chr(10) || '[Verse 2]' || chr(10) || 'once more—' || lang AS raw FROM documents"


@query(
    "clean_ascii",
    rf"""WITH t AS ({TAGGED_SQL}), bare AS (SELECT doc_id, translate(regexp_replace(regexp_replace(raw, '\[.*?\]', '', 'g'), '(?im)^[ \t]*(\d+\s*embed|see .+ live|get tickets|you might also like)[ \t]*$', '', 'g'), '‘’“”—–', '''''""--') AS b FROM t)
    SELECT doc_id, array_to_string(list_filter(list_transform(string_split(b, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS cleaned FROM bare""",
)
def clean_ascii(spark, d):
    return tagged(spark, d).select("doc_id", text.clean_ascii("raw").alias("cleaned"))


@query(
    "clean_text",
    rf"""WITH t AS ({TAGGED_SQL}), bare AS (SELECT doc_id, translate(replace(regexp_replace(regexp_replace(raw || ' ﬁne', '\[.*?\]', '', 'g'), '(?im)^[ \t]*(\d+\s*embed|see .+ live|get tickets|you might also like)[ \t]*$', '', 'g'), 'ﬁ', 'fi'), '‘’“”—–', '''''""--') AS b FROM t)
    SELECT doc_id, array_to_string(list_filter(list_transform(string_split(b, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS cleaned FROM bare""",
)
def clean_text(spark, d):
    """The tables' only character that compatibility normalisation changes is the ligature added here, so SQL replaces that one."""
    return tagged(spark, d).select("doc_id", text.clean_text(F.concat("raw", F.lit(" ﬁne"))).alias("cleaned"))


@query("tag_features", rf"WITH t AS ({TAGGED_SQL}) SELECT doc_id, regexp_matches(raw, '\[.+?\]') AS has_section_tags, len(regexp_extract_all(raw, '\[.+?\]')) AS section_count FROM t")
def tag_features(spark, d):
    return tagged(spark, d).select("doc_id", text.has_tags("raw").alias("has_section_tags"), text.tag_count("raw").alias("section_count"))


LINES_SQL = f"lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(raw, chr(10)) AS l FROM ({TAGGED_SQL}))), kinds AS (SELECT *, trim(line) AS bare, regexp_full_match(trim(line), '\\[.+\\]') AS tag FROM lines)"


@query(
    "extract_sections",
    f"""WITH {LINES_SQL}, others AS (SELECT *, tag AND NOT regexp_matches(bare, '(?i)^\\[\\s*verse') AS other FROM kinds),
    skips AS (SELECT *, coalesce(last_value(CASE WHEN tag THEN other END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS skip FROM others)
    SELECT doc_id, coalesce(trim(string_agg(line, chr(10) ORDER BY i) FILTER (NOT other AND NOT skip)), '') AS verse_only FROM skips GROUP BY doc_id""",
)
def extract_sections(spark, d):
    return tagged(spark, d).select("doc_id", sections.extract_sections("raw").alias("verse_only"))


@query(
    "chorus_cascade",
    f"""WITH {LINES_SQL}, opens AS (SELECT *, regexp_matches(bare, '(?i)\\[(chorus|hook|refrain)(\\s+\\d+)?\\]') AS opener FROM kinds),
    starts AS (SELECT doc_id, max(i) AS s FROM opens WHERE opener GROUP BY 1),
    stops AS (SELECT o.doc_id, s, coalesce(min(i) FILTER (tag AND i > s), 1000000) AS e FROM opens o JOIN starts USING (doc_id) GROUP BY 1, 2),
    found AS (SELECT o.doc_id, string_agg(bare, chr(10) ORDER BY i) FILTER (bare <> '') AS t FROM opens o JOIN stops p ON o.doc_id = p.doc_id AND o.i > s AND o.i < e GROUP BY 1)
    SELECT doc_id, true AS chorus_detected, 'tag' AS chorus_method, t AS chorus_text, CAST(len(regexp_extract_all(t, '\\S+')) AS BIGINT) AS chorus_token_count FROM found""",
)
def chorus_cascade(spark, d):
    """Every text has one chorus tag, so the SQL takes what follows it up to the next tag."""
    return tagged(spark, d).select("doc_id", *sections.chorus_cascade("raw"))


#: Stanzas of a document: its text, whole, and four short ones, some of which say the same.
RAW_STANZAS_SQL = "SELECT doc_id, text || chr(10) || chr(10) || source || ' one two three, four five!' || chr(10) || chr(10) || lang || ' other words stand here now' || chr(10) || chr(10) || upper(source) || ' one  two three four five' || chr(10) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN source || ' one two three four five' ELSE 'la la' END AS raw FROM documents"
STANZA_SQL = rf"""cut AS (SELECT doc_id, list_filter(list_transform(string_split_regex(raw, '\n{{2,}}'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM ({RAW_STANZAS_SQL})),
    each AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM cut),
    forms AS (SELECT doc_id, i, s, md5(trim(regexp_replace(regexp_replace(lower(s), '[^\pL\pM\pN\p{{Pc}}\s]', '', 'g'), '\s+', ' ', 'g'))) AS k FROM each),
    counted AS (SELECT doc_id, k, count(*) AS n, min(i) AS i, arg_min(s, i) AS s FROM forms GROUP BY 1, 2 HAVING count(*) >= 3),
    best AS (SELECT doc_id, arg_max(s, n * 1000000 - i) AS chorus_text, max(n) AS times FROM counted WHERE len(regexp_extract_all(s, '\S+')) >= 6 GROUP BY 1)"""


def stanzas(spark, d):
    last = F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit(" one two three four five"))).otherwise("la la")
    whole = F.concat_ws("\n\n", "text", F.concat("source", F.lit(" one two three, four five!")), F.concat("lang", F.lit(" other words stand here now")), F.concat(F.upper("source"), F.lit(" one  two three four five")), last)
    return table(spark, d, "documents").select("doc_id", whole.alias("raw"))


@query("repeated_stanza", f"WITH {STANZA_SQL} SELECT doc_id, chorus_text FROM documents LEFT JOIN best USING (doc_id)")
def repeated_stanza(spark, d):
    return stanzas(spark, d).select("doc_id", sections.repeated_stanza("raw").alias("chorus_text"))


@query("repeated_stanza_rows", f"WITH {STANZA_SQL} SELECT doc_id, chorus_text, times FROM best")
def repeated_stanza_rows(spark, d):
    return sections.repeated_stanza_rows(stanzas(spark, d), "doc_id", "raw")


@query("token_count", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS token_count FROM documents")
def token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", text.token_count("text").alias("token_count"))


def pronoun_list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query(
    "perspective",
    f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower('I saw ' || lang || ' you he ' || CASE WHEN doc_id % 2 = 0 THEN 'me my' WHEN doc_id % 3 = 0 THEN 'they''re them his' ELSE '' END || ' ' || text), '[a-z]+')) AS w FROM documents),
    c AS (SELECT doc_id, count(*) FILTER (w IN {pronoun_list(text.FIRST_PERSON)}) AS f, count(*) FILTER (w IN {pronoun_list(text.SECOND_PERSON)}) AS s, count(*) FILTER (w IN {pronoun_list(text.THIRD_PERSON)}) AS t FROM w GROUP BY 1)
    SELECT doc_id, CASE WHEN f + s + t = 0 THEN 'abstract' WHEN f / (f + s + t) >= 0.6 THEN 'first_person' WHEN s / (f + s + t) >= 0.6 THEN 'second_person' WHEN t / (f + s + t) >= 0.6 THEN 'third_person' ELSE 'abstract' END AS perspective FROM c""",
)
def perspective(spark, d):
    extra = F.when(F.col("doc_id") % 2 == 0, "me my").when(F.col("doc_id") % 3 == 0, "they're them his").otherwise("")
    whole = F.concat(F.lit("I saw "), "lang", F.lit(" you he "), extra, F.lit(" "), "text")
    return table(spark, d, "documents").select("doc_id", text.perspective(whole).alias("perspective"))


@query(
    "prompt_block",
    """SELECT doc_id // 5 AS batch_id, string_agg(r || '. song_id=' || doc_id || ' | "' || source || '" by x (' || lang || ') | themes:  | emotion: ', chr(10) ORDER BY r) AS prompt
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id // 5 ORDER BY doc_id) AS r FROM documents) GROUP BY 1""",
)
def prompt_block(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.expr("doc_id div 5").alias("batch_id"), F.col("doc_id").cast("string").alias("song_id"), F.col("source").alias("song_title"), F.lit("x").alias("artist"), F.col("lang").alias("decade"), F.lit("").alias("themes"), F.lit(None).cast("string").alias("emotional_tone"))
    return providers.prompt_lines(rows, "batch_id", ["doc_id"])


@query("year_extract", "SELECT o_orderkey, CAST(year(CAST(left(CAST(o_orderdate AS VARCHAR), 10) AS DATE)) AS BIGINT) AS year FROM orders")
def year_extract(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.year(F.to_date(F.date_format("o_orderdate", "yyyy-MM-dd"))).cast("long").alias("year"))


@query("pretty_label", "SELECT DISTINCT p_type, upper(left(p_type, 1)) || lower(substr(p_type, 2)) || ' Kind' AS label FROM part")
def pretty_label(spark, d):
    return table(spark, d, "part").select("p_type").distinct().select("p_type", text.pretty_label(F.concat(F.lower("p_type"), F.lit("_kind"))).alias("label"))


# Scores.


@query("ensemble_score", "SELECT event_id, round(least(greatest(0.6 * (value / 20 - 1) + 0.4 * (CAST(user_id AS DOUBLE) / 25 - 1), -1.0), 1.0), 4) AS score FROM events")
def ensemble_score(spark, d):
    return table(spark, d, "events").select("event_id", scores.ensemble_score(F.col("value") / 20 - 1, F.col("user_id").cast("double") / 25 - 1).alias("score"))


LEVEL_SQL = "CASE WHEN {0} IS NULL THEN NULL WHEN {0} < 0.2 THEN 1 WHEN {0} < 0.4 THEN 2 WHEN {0} < 0.6 THEN 3 WHEN {0} < 0.8 THEN 4 ELSE 5 END::BIGINT"


@query("bin_levels", with_songs(f"SELECT doc_id, {LEVEL_SQL.format('sentiment_score')} AS level FROM songs"))
def bin_levels(spark, d):
    return songs(spark, d, "doc_id", "sentiment_score").select("doc_id", scores.bin_levels("sentiment_score").alias("level"))


@query("quality_tier", "SELECT doc_id, CASE WHEN n_chars // 10 >= 50 THEN 'full' ELSE 'missing' END AS tier FROM documents")
def quality_tier(spark, d):
    return table(spark, d, "documents").select("doc_id", scores.quality_tier(F.expr("n_chars div 10")).alias("tier"))


@query("quality_tier_documented", "SELECT doc_id, CASE WHEN n_chars // 10 < 50 THEN 'missing' WHEN n_chars // 10 < 150 THEN 'partial' ELSE 'full' END AS tier FROM documents")
def quality_tier_documented(spark, d):
    return table(spark, d, "documents").select("doc_id", scores.quality_tier(F.expr("n_chars div 10"), documented=True).alias("tier"))


@query("contrast_index", with_songs("SELECT doc_id, CASE WHEN chorus_detected THEN round(chorus_sentiment_score - sentiment_score, 4) END AS contrast FROM songs"))
def contrast_index(spark, d):
    return songs(spark, d, "doc_id", "chorus_detected", "chorus_sentiment_score", "sentiment_score").select("doc_id", scores.contrast_index("chorus_detected", "chorus_sentiment_score", "sentiment_score").alias("contrast"))


@query("energy_shift", with_songs(f"SELECT doc_id, CASE WHEN chorus_detected AND l IS NOT NULL AND energy_level IS NOT NULL THEN CASE WHEN l > energy_level THEN 'increase' WHEN l < energy_level THEN 'decrease' ELSE 'stable' END END AS shift FROM (SELECT *, {LEVEL_SQL.format('chorus_sentiment_score')} AS l FROM songs)"))
def energy_shift(spark, d):
    return songs(spark, d, "doc_id", "chorus_detected", "chorus_sentiment_score", "energy_level").select("doc_id", scores.energy_shift("chorus_detected", "chorus_sentiment_score", "energy_level").alias("shift"))


@query("theme_shift", with_songs("SELECT doc_id, CASE WHEN chorus_detected AND themes IS NOT NULL THEN CASE WHEN emotional_tone IS NULL OR chorus_emotional_tone IS NULL OR emotional_tone = chorus_emotional_tone THEN 'none' ELSE 'minor' END END AS shift FROM songs"))
def theme_shift(spark, d):
    return songs(spark, d, "doc_id", "chorus_detected", "themes", "emotional_tone", "chorus_emotional_tone").select("doc_id", scores.theme_shift("chorus_detected", "themes", "emotional_tone", "chorus_emotional_tone").alias("shift"))


@query("resonance_score", with_songs(f"SELECT doc_id, CASE WHEN sentiment_score IS NULL OR energy_level IS NULL OR development_score IS NULL THEN NULL ELSE {RESONANCE_SQL} END AS score FROM songs"))
def resonance_score(spark, d):
    return songs(spark, d).select("doc_id", scores.resonance_score().alias("score"))


#: A label for each of the 64 dimensions.
AXES = [f"s{i}" for i in range(64)]
VECTOR_SQL = "SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 6)) AS v FROM embeddings"


def vectors(spark, d):
    labels = F.array(*map(F.lit, AXES))
    values = F.transform("embedding", lambda x: F.round(x.cast("double"), 6))
    return table(spark, d, "embeddings").select("vec_id", F.map_from_arrays(labels, values).alias("scores"))


@query("dominant_label", f"SELECT vec_id, 's' || (list_position(v, list_max(v)) - 1) AS label FROM ({VECTOR_SQL})")
def dominant_label(spark, d):
    return vectors(spark, d).select("vec_id", scores.dominant_label("scores", AXES).alias("label"))


ACTIVE_SQL = f"SELECT v.vec_id, coalesce(string_agg('s' || (i - 1), '|' ORDER BY x DESC, i), '') AS tags FROM (SELECT vec_id FROM embeddings) v LEFT JOIN (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM ({VECTOR_SQL})) e ON v.vec_id = e.vec_id AND x >= {{}} GROUP BY 1"


@query("active_tags", ACTIVE_SQL.format("0.05"))
def active_tags(spark, d):
    return vectors(spark, d).select("vec_id", scores.active_tags("scores", AXES, 0.05).alias("tags"))


@query("rank_tags", ACTIVE_SQL.format("-1000"))
def rank_tags(spark, d):
    return vectors(spark, d).select("vec_id", F.array_join(scores.ranked_tags("scores", AXES, -1000.0), "|").alias("tags"))


@query("widen_scores", f"SELECT vec_id, {', '.join(f'v[{i + 1}] AS emotion_{axis}' for i, axis in enumerate(AXES))}, CAST(NULL AS DOUBLE) AS emotion_other FROM ({VECTOR_SQL})")
def widen_scores(spark, d):
    return vectors(spark, d).select("vec_id", *scores.widened("scores", [*AXES, "other"], "emotion"))


@query("quality_flag", with_songs("SELECT doc_id, CASE WHEN jung_stage <> 'unclassified' AND development_score IS NOT NULL THEN 'high' ELSE 'low' END AS flag FROM songs"))
def quality_flag(spark, d):
    return songs(spark, d, "doc_id", "jung_stage", "development_score").select("doc_id", scores.quality_flag("jung_stage", "development_score").alias("flag"))


def hits_sql(words) -> str:
    return f"len(regexp_extract_all(' ' || regexp_replace(lower(text), '[^a-z]+', '  ', 'g') || ' ', ' ({'|'.join(words)}) '))"


@query(
    "lexicon_score",
    f"""WITH h AS (SELECT doc_id, CAST({hits_sql(providers.POSITIVE)} AS DOUBLE) AS p, CAST({hits_sql(providers.NEGATIVE)} AS DOUBLE) AS n FROM documents),
    s AS (SELECT doc_id, round(2 * (p - n) / sqrt(4 * (p - n) * (p - n) + {providers.ALPHA}), 4) AS v, CASE WHEN p + n = 0 THEN 0.0 ELSE (p - n) / (p + n) END AS b FROM h)
    SELECT doc_id, round(least(greatest(0.6 * v + 0.4 * b, -1.0), 1.0), 4) AS score FROM s""",
)
def lexicon_score(spark, d):
    return table(spark, d, "documents").select("doc_id", providers.listed_score("text").alias("score"))


TONES = ("joy", "anger", "fear")
TONE_SQL = "CAST(('0x' || left(md5('{0}|' || CASE WHEN trim(coalesce(text, ''), chr(9) || chr(10) || chr(13) || ' ') = '' THEN ' ' ELSE text END), 8)) AS BIGINT)"


@query(
    "classify_emotion",
    f"WITH t AS (SELECT doc_id, {', '.join(f'{TONE_SQL.format(t)} AS {t}' for t in TONES)} FROM documents) SELECT doc_id, CASE WHEN joy >= anger AND joy >= fear THEN 'joy' WHEN anger >= fear THEN 'anger' ELSE 'fear' END AS tone FROM t",
)
def classify_emotion(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text")
    return rows.select("doc_id", scores.dominant_label(providers.classify("text", TONES, providers.hashed_labels(TONES)), TONES).alias("tone"))


def measured() -> providers.Provider:
    """A provider that gives every text's own length, so that a result that met another row would show."""
    return lambda texts: [{"length": float(len(t)), "blank": float(not t.strip())} for t in texts]


@query("positional_zip", "SELECT doc_id, CAST(length(t) AS DOUBLE) AS length, CASE WHEN t = ' ' THEN 1.0 ELSE 0.0 END::DOUBLE AS blank FROM (SELECT doc_id, CASE WHEN trim(coalesce(text, ''), chr(9) || chr(10) || chr(13) || ' ') = '' THEN ' ' ELSE text END AS t FROM documents)")
def positional_zip(spark, d):
    scored = table(spark, d, "documents").select("doc_id", providers.classify("text", ("length", "blank"), measured, 7).alias("s"))
    return scored.select("doc_id", F.col("s.length").alias("length"), F.col("s.blank").alias("blank"))


@query("without_provider", "SELECT doc_id, 'unclassified' AS jung_stage, CAST(NULL AS VARCHAR) AS psychological_theme, CAST(NULL AS BIGINT) AS development_score FROM documents")
def without_provider(spark, d):
    return providers.without_provider(table(spark, d, "documents").select("doc_id"))


# Replies and schemas.


@query(
    "parse_llm_json",
    """SELECT event_id AS batch_id, CAST(0 AS INTEGER) AS position, 'e' || event_id AS song_id, CASE WHEN event_id % 3 = 0 THEN 'shadow' ELSE 'unclassified' END AS jung_stage, nullif(CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END, '') AS psychological_theme,
    CASE WHEN user_id BETWEEN 1 AND 7 THEN user_id END AS development_score FROM events WHERE event_id % 4 <> 2""",
)
def parse_llm_json(spark, d):
    stage = F.when(F.col("event_id") % 3 == 0, " Shadow ").otherwise("dreaming")
    theme = F.when(F.col("event_id") % 5 == 0, " ").otherwise(F.col("event_type"))
    record = F.concat(F.lit('{"song_id":"e'), F.col("event_id"), F.lit('","jung_stage":"'), stage, F.lit('","psychological_theme":"'), theme, F.lit('","development_score":'), F.col("user_id"), F.when(F.col("event_id") % 2 == 0, ".7").otherwise(""), F.lit("}"))
    array = F.concat(F.lit("["), record, F.lit(', 5, {"song_id":" "}]'))
    reply = F.when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"songs":'), array, F.lit("}"))).when(F.col("event_id") % 4 == 2, F.concat(array, F.lit("x"))).otherwise(array)
    return replies.parse_replies(table(spark, d, "events").select(F.col("event_id").alias("batch_id"), reply.alias("reply")))


CHECKED = TableSchema("checked", (Field("energy_level", "long", False, allowed=(1, 2, 3, 4)), Field("sentiment_score", "double", True, -0.5, 0.9), Field("lyrics_quality", "string", allowed=("full", "partial"))))


@query(
    "schema_violations",
    with_songs(
        """SELECT 'energy_level' AS "column", 'not_null' AS rule, CAST(NULL AS VARCHAR) AS value FROM songs WHERE energy_level IS NULL
    UNION ALL SELECT 'energy_level', 'allowed', CAST(energy_level AS VARCHAR) FROM songs WHERE energy_level NOT IN (1, 2, 3, 4)
    UNION ALL SELECT 'sentiment_score', '>=-0.5', CAST(round(sentiment_score, 6) AS VARCHAR) FROM songs WHERE round(sentiment_score, 6) < -0.5
    UNION ALL SELECT 'sentiment_score', '<=0.9', CAST(round(sentiment_score, 6) AS VARCHAR) FROM songs WHERE round(sentiment_score, 6) > 0.9
    UNION ALL SELECT 'lyrics_quality', 'allowed', lyrics_quality FROM songs WHERE lyrics_quality NOT IN ('full', 'partial')"""
    ),
)
def schema_violations(spark, d):
    return CHECKED.violations(songs(spark, d, "energy_level", "sentiment_score", "lyrics_quality").withColumn("sentiment_score", F.round("sentiment_score", 6)))


# Modules that register more queries.
from moodspark.plans import key_queries, opinion_queries, stream_queries  # noqa: E402, F401
