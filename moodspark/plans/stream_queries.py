"""Registered queries that run as streams."""

from __future__ import annotations

from moodspark.plans.catalogue import ORACLES, query
from moodspark.plans.proxies import ENTRY_ORDER, entries
from moodspark.sources import files
from moodspark.streaming import canonical

#: Batches that the landed rows are dealt into, at least.
BATCHES = 4


@query("stream_dedupe", ORACLES["dedupe_canonical"])
def stream_dedupe(spark, d):
    """All entries land as files and are taken in over several batches, with a snapshot among them."""
    rows = entries(spark, d)
    landing, work = files.scratch(spark, "landing"), files.scratch(spark, "stream")
    rows.write.parquet(landing)
    landed = spark.read.parquet(landing)
    if len(landed.inputFiles()) < BATCHES:
        dealt = files.scratch(spark, "landing")
        landed.write.option("maxRecordsPerFile", landed.count() // BATCHES + 1).parquet(dealt)
        landing, landed = dealt, spark.read.parquet(dealt)
    several = max(1, len(landed.inputFiles()) // BATCHES)
    stream = spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", several).parquet(landing)
    canonical.keep_canonical(stream, ENTRY_ORDER, f"{work}/table", f"{work}/state", compact_every=3).awaitTermination()
    return canonical.read_canonical(spark, f"{work}/table")
