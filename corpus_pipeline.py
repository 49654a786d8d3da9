"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again.

1. toxicity: documents that the pattern grammar rejects go.
2. near_duplicates: of documents joined by links of 80 % of five-word shingles the one with the smallest id stays.
   Different texts under one id are documents of their own; of rows alike in id and text one stays.
3. decontamination: documents that hold a benchmark item go.
4. secrets: secrets are masked; every document stays and ``n_chars`` follows its text.
5. tokens: token ids of every text, and whether they decode to it.

Null and empty texts are clean documents: they pass every stage, a null text stays null until the last one, where it
has no ids. Documents without an id are compared with no other and stay. Without labels the seeds of the grammar
decide; without benchmark items nothing leaks; an empty table of documents gives an empty result. Extra columns of
``documents``, whatever their names, are carried to the last stage, which returns its own columns only; extra columns
of ``labels`` and ``benchmark`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodspark.llm import bpe, decontaminate, jaccard, secrets, toxicity
from moodspark.llm.common import grown, materialise, table, told_apart

REJECT_FROM = 0.7
#: Ids that may be broadcast, a few MB; more are merged.
MOST_BROADCAST = 200_000


def bounded(ids: DataFrame) -> DataFrame:
    """A side of a join that is broadcast only after its rows are counted."""
    return F.broadcast(ids) if ids.count() <= MOST_BROADCAST else grown(ids)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, out="__toxicity")
    return scored.where(F.col("__toxicity") < REJECT_FROM).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = [F.col(f"`{c}`") for c in docs.columns]
    known = docs.where(F.col("doc_id").isNotNull())
    rows, names = told_apart(known, "doc_id", "text")
    classes = materialise(jaccard.similarity_components(rows.select("__row", "text"), "__row", "text", size=5, percent=80), "components")
    gone = classes.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__row"))
    if names is None:
        return docs.join(bounded(gone), docs["doc_id"] == gone["__row"], "left_anti").select(*columns)
    kept = rows.join(bounded(gone), "__row", "left_anti").select(*columns, "__row")
    # Of rows alike in id and text one stays.
    one = kept.groupBy("__row").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("__one")).select("__one.*")
    return one.unionByName(docs.where(F.col("doc_id").isNull()))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, length="n_chars")


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    both = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"))
    return both.select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        "token_ids",
        (F.coalesce("text", F.lit("")).cast("binary") == F.col("raw_bytes")).alias("decodes"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("tokens", to_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has no byte-level BPE, learned grammar or automata.
ORACLE_SQL = None
