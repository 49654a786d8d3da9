"""How often hashed tokens occur: a table of counters whose size is bounded whatever the corpus.

Every token counts, all tasks' tables are added up, and a counter never shows less than a
token's own count (Cormode and Muthukrishnan, "The count-min sketch", 2005, with one row).
Operators take from it an order of tokens, rare ones first, or which tokens are hot. Both
decide how work is dealt out, never a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from moodspark.llm.common import bound_batches

SLICE = 1 << 16
LEAST_SLOTS, MOST_SLOTS = 1 << 16, 1 << 24
BYTES_A_SLOT = 512


def slots_for(n_bytes: int) -> int:
    """Counters for so many bytes of text: a power of two, 16 MB of classes at most."""
    return min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (max(1, n_bytes) // BYTES_A_SLOT).bit_length()))


def frequency_classes(rows: DataFrame, tokens_of: Callable[[pa.RecordBatch], np.ndarray], slots: int) -> tuple[np.ndarray, float]:
    """(the class of each counter, the mean count): class c > 0 stands for counts from 2^(c-1) on; token t has counter t mod ``slots``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(slots, dtype=np.uint32)
        held: list[np.ndarray] = []
        size = 0

        def add() -> None:
            nonlocal held, size, table
            table += np.bincount(np.concatenate(held), minlength=slots).astype(np.uint32)
            held, size = [], 0

        for batch in batches:
            held.append((tokens_of(batch) & np.uint64(slots - 1)).astype(np.int32))
            size += len(held[-1])
            if size > slots:
                add()
        if held:
            add()
        press = zstandard.ZstdCompressor(level=1)
        for at in range(0, slots, SLICE):
            part = table[at : at + SLICE]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([at // SLICE]), pa.array([press.compress(part.tobytes())], pa.binary())], names=["slice", "block"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint32)
                sums[k] = sums[k] + part if k in sums else part.astype(np.int64)
        for k, part in sums.items():
            classes = np.where(part > 0, np.log2(np.maximum(part, 1)).astype(np.uint8) + 1, 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([classes.tobytes()], pa.binary()), pa.array([int(part.sum())])], names=["slice", "classes", "n"])

    bound_batches(rows.sparkSession)
    tables = rows.mapInArrow(count, "slice long, block binary")
    parts = min(slots // SLICE, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Streamed: a task holds the sums of its slices, however many tasks have sent tables.
    summed = tables.repartition(max(1, parts), "slice").mapInArrow(total, "slice long, classes binary, n long").collect()
    classes = np.zeros(slots, dtype=np.uint8)
    for r in summed:
        classes[r["slice"] * SLICE : r["slice"] * SLICE + SLICE] = np.frombuffer(bytes(r["classes"]), np.uint8)
    return classes, sum(r["n"] for r in summed) / slots
