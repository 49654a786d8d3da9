"""Parsing of model replies in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodspark.config import STAGE_LABELS


def parse_replies(df: DataFrame, reply: str = "reply", keys: tuple[str, ...] = ("batch_id",)) -> DataFrame:
    """One row per record of each reply: an array of objects, or an object with one value that is such an array.

    Bad JSON and other shapes give no rows (their batch is then retried). Records that are no
    objects or have no id are skipped. Labels outside the closed set become 'unclassified', scores
    are whole numbers from 1 to 7 or null, empty themes are null.
    """
    # The parser stops at the end of the first value, so what follows it is looked at here.
    closed = F.when(F.col(reply).rlike(r"[\]}]\s*\z"), F.col(reply))
    parsed = df.select(*keys, F.try_parse_json(closed).alias("v"))
    kind = F.schema_of_variant("v")
    fields = F.try_variant_get("v", "$", "map<string,variant>")
    body = F.when(kind.startswith("ARRAY"), F.col("v")).when(kind.startswith("OBJECT") & (F.size(fields) == 1), F.element_at(F.map_values(fields), 1))
    records = F.try_variant_get(body, "$", "array<variant>")
    rows = parsed.select(*keys, F.posexplode(records).alias("position", "r")).where(F.schema_of_variant("r").startswith("OBJECT"))
    text = lambda name: F.trim(F.try_variant_get("r", f"$.{name}", "string"))
    stage = F.lower(text("jung_stage"))
    return rows.select(
        *keys,
        "position",
        text("song_id").alias("song_id"),
        F.when(stage.isin(*STAGE_LABELS), stage).otherwise("unclassified").alias("jung_stage"),
        F.when(text("psychological_theme") != "", text("psychological_theme")).alias("psychological_theme"),
        whole_score(F.col("r")).alias("development_score"),
    ).where(F.coalesce(F.col("song_id"), F.lit("")) != "")


def whole_score(record: Column, low: int = 1, high: int = 7) -> Column:
    """A JSON number is truncated, a JSON string must be a whole number; outside the range it is null."""
    raw = F.try_variant_get(record, "$.development_score", "string")
    quoted = F.schema_of_variant(F.try_variant_get(record, "$.development_score", "variant")) == "STRING"
    number = F.when(quoted, F.when(F.trim(raw).rlike(r"^[+-]?\d+$"), F.trim(raw).try_cast("long"))).otherwise(raw.try_cast("double").cast("long"))
    return F.when(number.between(low, high), number)


def reconcile(requested: DataFrame, records: DataFrame, batch: str = "batch_id", key: str = "song_id") -> DataFrame:
    """Requested ids with their records: a batch with any id missing has none; the last of repeated ids counts, others are ignored."""
    last = records.groupBy(batch, key).agg(F.max_by(F.struct("jung_stage", "psychological_theme", "development_score"), "position").alias("r"))
    met = requested.join(last, [batch, key], "left")
    whole = met.groupBy(batch).agg(F.bool_and(F.col("r").isNotNull()).alias("complete"))
    return met.join(whole, batch).select(batch, key, "complete", *(F.when(F.col("complete"), F.col(f"r.{c}")).alias(c) for c in ("jung_stage", "psychological_theme", "development_score")))
