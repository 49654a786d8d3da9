"""File sources and sinks. Paths go through Spark or Hadoop, so any store that Spark reaches will do."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


LOCAL_CHECKPOINTS = "/tmp/checkpoints/moodspark"


class MissingInputError(FileNotFoundError):
    """A required input is absent; the message names the stage that makes it."""


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, none where it is absent."""
    fs, target = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target) if s.isDirectory()) if fs.exists(target) else []


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, size and time of change of every file at or below a path, in the order of names; none where it is absent."""
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        return []
    found, files = [], fs.listFiles(target, True)
    while files.hasNext():
        status = files.next()
        found.append((status.getPath().toString(), int(status.getLen()), int(status.getModificationTime())))
    return sorted(found)


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.delete(target, True)


def require_path(spark: SparkSession, path: str, stage: str) -> str:
    if not exists(spark, path):
        raise MissingInputError(f"{path} is missing; run stage {stage} first")
    return path


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, text: Sequence[str] = ()) -> DataFrame:
    """A CSV file with a header and quoted line ends.

    With a schema, ids of digits stay text. Without one the types are inferred from all rows, but for the columns
    named in ``text``, which stay strings as they stand.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if schema is not None:
        return reader.schema(schema).csv(path)
    kinds = reader.option("inferSchema", True).csv(path).schema
    pinned = T.StructType([T.StructField(f.name, T.StringType()) if f.name in text else f for f in kinds.fields])
    return reader.schema(pinned).csv(path)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet, or an empty table of the schema where the path is absent."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", quote_all).option("escape", '"').csv(path)


def write_atomic(df: DataFrame, path: str, kind: str = "parquet", check: Callable[[DataFrame], DataFrame | None] | None = None) -> None:
    """Write beside the target, then rename: a write that fails leaves the target as it was.

    ``check`` sees the written rows before they take the target's place: it raises to refuse them, and may give
    other rows, made from the written ones, that take it instead. So ``df`` is computed once.
    """
    spark = df.sparkSession
    fs, target = _fs(spark, path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    staging, changed, old = (hadoop(f"{path}.{word}-{uuid.uuid4().hex}") for word in ("staging", "changed", "old"))
    try:
        df.write.format(kind).save(staging.toString())
        ready = staging
        other = check(spark.read.schema(df.schema).format(kind).load(staging.toString())) if check else None
        if other is not None:
            other.write.format(kind).save(changed.toString())
            ready = changed
        if fs.exists(target):
            fs.rename(target, old)
        if not fs.rename(ready, target):
            fs.rename(old, target)
            raise OSError(f"can't rename to {path}")
        fs.delete(old, True)
    finally:
        fs.delete(staging, True)
        fs.delete(changed, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    A session on one machine may leave it unset; on a cluster that is an error.
    """
    root, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not root and not re.match(r"local(\[|$)", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    return (root or LOCAL_CHECKPOINTS).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver's process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None and not context._jsc.sc().isStopped():
        fs, target = _fs(spark, path)
        fs.delete(target, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back; they go when the driver's process ends."""
    df.write.parquet(path := scratch(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows as they are now, in the shared folder, which outlives executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file in any store."""
    fs, target = _fs(spark, path)
    out = fs.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file, None where it is absent or no text."""
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        return None
    try:
        stream = fs.open(target)
        data = bytes(stream.readAllBytes())
        stream.close()
        return data.decode()
    except (UnicodeDecodeError, OSError):
        return None


def nulls_for_blank(df: DataFrame, columns: Mapping[str, str] | list[str]) -> DataFrame:
    """'' as null, as a trip through CSV has it."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in columns})
