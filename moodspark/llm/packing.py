"""Packed strings of numbers and bytes that travel between tasks, and hashes over byte arrays.

Rows that meet in a bucket leave a task as one compressed block for each bucket, so a
shuffle moves few large binaries instead of many small rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodspark.llm.common import bound_batches, field, map_column

ODD = np.uint64(0x9E3779B97F4A7C15)
ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPREAD = np.uint64(0xD6E8FEB86659FD93)
LEVEL = 3


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    values = values ^ (values >> np.uint64(32))
    values = values * SPREAD
    return values ^ (values >> np.uint64(29))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def scattered(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers (the splitmix sequence from ``seed``)."""
    z = np.arange(1, n + 1, dtype=np.uint64) * ODD + np.uint64(seed)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


BYTE_NUMBERS = scattered(256, 11)
PLACE_NUMBERS = scattered(4096, 23)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, chunk: int = 1 << 19) -> np.ndarray:
    """A 64-bit hash of each run of bytes ``values[start:end]``; runs ascend and don't overlap.

    Every place of a run has a multiplier of its own from a fixed pseudo-random sequence: with powers of one
    number, words of certain regular patterns would meet. Runs are hashed in chunks of about ``chunk`` values,
    so that memory follows the longest run only.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + chunk, side="right")))
        base, stop = int(starts[at]), int(ends[upto - 1])
        first, last = starts[at:upto] - base, ends[at:upto] - base
        spans = np.diff(np.append(first, stop - base))
        longest = int(spans.max())
        numbers = PLACE_NUMBERS if longest <= len(PLACE_NUMBERS) else scattered(longest, 23)
        place = np.arange(stop - base) - np.repeat(first, spans)
        sums = np.zeros(stop - base + 1, dtype=np.uint64)
        np.cumsum(BYTE_NUMBERS[values[base:stop]] * numbers[place], out=sums[1:])
        out[at:upto] = sums[last] - sums[first] + (last - first).astype(np.uint64)
        at = upto
    return mix(out)


def window_hashes_of(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive word hashes."""
    n = len(words)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(ODD, n), dtype=np.uint64)])
    return mix((sums[k:] - sums[:-k]) * powers(ODD_INVERSE, n - k + 1))


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of one block as compressed bytes; integers as differences, which are small where rows are in order."""
    parts = [np.array([len(arrays), *(x for a in arrays for x in (len(a), a.dtype.num, a.dtype.kind == "i"))], dtype=np.int64).tobytes()]
    for a in arrays:
        parts.append((np.diff(a, prepend=a.dtype.type(0)) if a.dtype.kind == "i" else a).tobytes())
    return zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(parts))


def spread_out(block: bytes) -> list[np.ndarray]:
    """The arrays of a block."""
    raw = zstandard.ZstdDecompressor().decompress(block)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    heads = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(n, 3)
    at, out = 8 + 24 * n, []
    kinds = {np.dtype(k).num: np.dtype(k) for k in (np.int64, np.int32, np.uint64, np.uint8, np.int16)}
    for length, number, signed in heads.tolist():
        kind = kinds[number]
        a = np.frombuffer(raw, kind, length, at)
        at += length * kind.itemsize
        out.append(np.cumsum(a, dtype=kind) if signed else a)
    return out


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indexes of its rows in their order)."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, edges):
        if len(part):
            yield int(bucket[part[0]]), part


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, ``count`` numbers each."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0


def compressed(docs: DataFrame, text: str = "text", out: str = "packed_text") -> DataFrame:
    """Replace the text by its compressed UTF-8 bytes (null: none), for a shuffle of whole texts."""

    def run(values: list) -> list[pa.Array]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        return [pa.array([None if v is None else press.compress(v.encode("utf-8", "surrogatepass")) for v in values], pa.binary())]

    bound_batches(docs.sparkSession)
    return map_column(docs, text, run, [field(out, T.BinaryType())], [c for c in docs.columns if c != text])


def restored(block: bytes | None) -> bytes:
    return b"" if block is None else zstandard.ZstdDecompressor().decompress(block)
