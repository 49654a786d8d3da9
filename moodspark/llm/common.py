"""What the training-data operators share: sessions, shared storage and Arrow maps."""

from __future__ import annotations

import atexit
import re
import sys
import time
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of one Arrow batch between Spark and Python; a longer text travels alone.
BATCH_BYTES = 4 << 20
#: Rows that a Parquet scan holds at once. Spark's 4,096 texts are arrays of tens of MB, for which the heap grows and stays large.
SCAN_ROWS = 256
#: Rows of a few numbers that may be broadcast: some 10 MB.
FEW_ROWS = 200_000
FALLBACK_CHECKPOINT_DIR = "/tmp/checkpoints/moodspark"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, whatever the length of the texts, and how many texts a scan holds."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(SCAN_ROWS))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    A session on one machine may leave it unset; on a cluster that is an error, as executors don't see each other's disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        root = FALLBACK_CHECKPOINT_DIR
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver's process ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    The files outlive any executor, so a later stage never recomputes ``df``. They go with ``discard``
    or when the driver's process ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._scratch_path = path
    return made


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialise`` has written, once all that was made of them is written too."""
    for made in tables:
        _remove(made.sparkSession, made._scratch_path)


def reclaim(spark: SparkSession, looks: int = 3, pause: float = 0.7) -> None:
    """Let the shuffle files of written tables go.

    Spark removes them when the driver's JVM finds that nothing refers to them, which without being asked it may do
    much later; so a step that has moved what is as large as the texts asks. Listeners still hold a plan that
    has just ended, so it asks again after a pause.
    """
    for _ in range(looks):
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def grown(df: DataFrame) -> DataFrame:
    """Mark a side of a join whose size follows the corpus: it is merged, never broadcast."""
    return df.hint("merge")


def checked(table: DataFrame, part: DataFrame | None = None) -> DataFrame:
    """A side of a join that is broadcast if the written table has few rows of numbers, else merged.

    ``part``: what is joined of the table, if not all of it.
    """
    side = table if part is None else part
    return F.broadcast(side) if table.count() <= FEW_ROWS else grown(side)


def smallest_of_key(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Add ``smallest``, the least ``value`` of the row's ``key``, to the rows whose key repeats.

    A key with a third of all rows is dealt out by a second key, from ``value``, in both joins: per key there are
    at most as many second keys as shuffle partitions, and the rows of one second key are a partition's share.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("__deal", F.pmod(F.xxhash64(value), F.lit(parts)).cast("int"))
    some = dealt.groupBy(key, "__deal").agg(F.min(value).alias("low"), F.count("*").alias("n"))
    whole = some.groupBy(key).agg(F.min("low").alias("smallest"), F.sum("n").alias("n")).where("n > 1").select(key, "smallest")
    return dealt.join(grown(some.join(grown(whole), key).select(key, "__deal", "smallest")), [key, "__deal"]).drop("__deal")


def joined_by_key(rows: DataFrame, key: str, value: str, facts: DataFrame) -> DataFrame:
    """Left join ``facts``, one row a key, to rows of which a third may have one key; dealt out as in ``smallest_of_key``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("__deal", F.pmod(F.xxhash64(value), F.lit(parts)).cast("int"))
    near = dealt.select(key, "__deal").distinct().join(grown(facts), key)
    return dealt.join(grown(near), [key, "__deal"], "left").drop("__deal")


def told_apart(docs: DataFrame, doc_id: str, text: str, row: str = "__row") -> tuple[DataFrame, DataFrame | None]:
    """Add ``row``, a number for each pair of id and text, in the order of ids (null last) and then of the texts' hashes.

    Where no id repeats or is null it is the id itself, and the second result None. Otherwise the pairs are sorted and
    numbered by their place, without the texts, and the second result has ``row`` and the id, ``of``, of each.
    """
    key = F.col(f"`{doc_id}`").cast("long")
    if docs.groupBy(key.alias("id")).agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL").isEmpty():
        return docs.withColumn(row, key), None
    pairs = docs.select(key.alias("__of"), F.xxhash64(f"`{text}`").alias("__hash")).distinct()
    order = [F.col("__of").asc_nulls_last(), F.col("__hash")]
    # The number of a range and the place in it, so the numbers ascend over all ranges.
    numbered = materialise(pairs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(row, F.monotonically_increasing_id()), "rows")
    same = key.eqNullSafe(F.col("__of")) & (F.xxhash64(f"`{text}`") == F.col("__hash"))
    return materialise(docs.join(checked(numbered), same).drop("__of", "__hash"), "rows"), numbered.select(row, F.col("__of").alias("of"))


def given_ids(made: DataFrame, names: DataFrame | None, *columns: str) -> DataFrame:
    """Rows of numbers from ``told_apart`` with the ids that they stand for in the named columns."""
    for column in columns if names is not None else ():
        of = names.select(F.col(names.columns[0]).alias("__number"), "of")
        at = made.columns.index(column)
        joined = made.join(grown(of), F.col(column) == F.col("__number"), "left")
        made = joined.select(*made.columns[:at], F.col("of").alias(column), *made.columns[at + 1 :])
    return made


def process_cache() -> dict:
    """A dictionary that lives as long as the Python process.

    Functions reach a worker anew for each task; what is costly to build is kept
    here, so that a worker that is used again has it already.
    """
    holder = sys.modules.setdefault("_moodspark_process_cache", types.ModuleType("_moodspark_process_cache"))
    return holder.__dict__.setdefault("kept", {})


def cached(key, build: Callable, version: str = ""):
    """``build()``, made once a process for each key; another version takes the place of the last one."""
    kept = process_cache()
    if key not in kept or kept[key][0] != version:
        kept.pop(key, None)
        kept[key] = (version, build())
    return kept[key][1]


def kept_fields(df: DataFrame, keep: list[str] | None, new: list[T.StructField]) -> list[T.StructField]:
    """Fields of ``df`` that a map carries along; those that clash with new names go."""
    names = {f.name for f in new}
    return [f for f in df.schema.fields if f.name not in names and (keep is None or f.name in keep)]


def map_column(
    df: DataFrame,
    column: str,
    fn: Callable[[list], list[pa.Array]],
    new: list[T.StructField],
    keep: list[str] | None = None,
) -> DataFrame:
    """Append columns computed by ``fn`` from the values of one column, batch by batch.

    ``keep`` names the columns to carry (all by default). A carried column with
    the name of a new one is replaced by it. No shuffle, one batch in memory.
    """
    bound_batches(df.sparkSession)
    carried = kept_fields(df, keep, new)
    names = [f.name for f in carried]
    source = "__value"
    frame = df.select(*(F.col(f"`{n}`") for n in names), F.col(f"`{column}`").alias(source))
    schema = T.StructType(carried + new)
    labels = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn(batch.column(len(names)).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))] + made, names=labels)

    return frame.mapInArrow(run, schema)


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind)
