"""Substring deduplication with super-k-mers of words.

A window is ``k`` consecutive words of one document. Its minimiser is the rarest run of
``m`` words in it, by counters over all documents, and of equally rare ones that with
the smallest hash; consecutive windows with the same minimiser travel as one packed
string to the minimiser's bucket. There all windows are sorted by a hash of their words
and those that are equal word by word are counted exactly: each but the earliest is
removed. Within a task equal packed strings travel once, so the copies of a hot passage
are gathered before the shuffle.

A window whose every run is hot has a hot minimiser, which would send all its contexts to
one bucket. Such windows travel singly, to the bucket of a hash of their words.

Words are separated by white space and kept as they are. Null, empty and
shorter texts have no windows. Rows that repeat an id and a text hold the same
positions, none of which is earlier than the other; different texts of one id are
documents of their own, in the order of their hashes, and rows without an id come after
all others (``repeated_spans`` alone goes by the ids as they are). An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodspark.llm.common import bound_batches, given_ids, grown, table, told_apart
from moodspark.llm.packing import by_bucket, compressed, expand, restored, run_hashes, spread_out, squeeze, text_bytes, window_hashes_of
from moodspark.llm.sketch import frequency_classes, slots_for

SEPARATES = np.zeros(256, dtype=bool)
SEPARATES[[0x20, *range(0x09, 0x0E)]] = True
#: A run of words that occurs more often than this, and than four times the mean of the counters, is hot.
HOT_RUNS = 20_000
PARTITION_BYTES = 64 << 20
SPANS = "doc_id long, first long, last long"


def normalised(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words joined by single spaces: the bytes, starts and ends of words and the text of each word."""
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    raw = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    apart = SEPARATES[raw]
    inner = ~apart
    before = np.concatenate([[True], apart[:-1]]) if len(raw) else apart
    starts = np.flatnonzero(inner & before)
    ends = np.flatnonzero(apart & ~before)
    owner = np.searchsorted(np.cumsum(lengths), starts, side="right")
    keep = inner.copy()
    keep[ends] = True
    sizes = ends - starts
    joined = np.where(apart, np.uint8(32), raw)[keep]
    new_starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(sizes) else sizes
    return joined, new_starts, new_starts + sizes, owner


@dataclass(frozen=True)
class Rarity:
    """The frequency class of each counter of runs of words, and the class from which they are hot."""

    classes: np.ndarray
    hot: int

    def of(self, grams: np.ndarray) -> np.ndarray:
        return self.classes[(grams & np.uint64(len(self.classes) - 1)).astype(np.int64)]


def rarity(docs: DataFrame, m: int, slots: int) -> Rarity:
    def runs(batch: pa.RecordBatch) -> np.ndarray:
        joined, starts, ends, _ = normalised(encoded(batch.column(1).to_pylist()))
        return window_hashes_of(run_hashes(joined, starts, ends), m)

    classes, mean = frequency_classes(docs, runs, slots)
    return Rarity(classes, math.ceil(math.log2(max(HOT_RUNS, 4 * mean))) + 1)


def encoded(texts: list) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def super_kmers(words: np.ndarray, owner: np.ndarray, k: int, m: int, rare: Rarity) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, hash that deals them out) of the maximal runs of windows that share a minimiser in place.

    Windows with a hot minimiser are runs of their own.
    """
    if len(words) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = window_hashes_of(words, m)
    width = k - m + 1
    classes = rare.of(grams)
    order = (classes.astype(np.uint64) << np.uint64(56)) | (grams >> np.uint64(8))
    best = np.lib.stride_tricks.sliding_window_view(order, width).argmin(axis=1) + np.arange(len(words) - k + 1)
    valid = owner[: len(words) - k + 1] == owner[k - 1 :]
    window = np.flatnonzero(valid)
    if not len(window):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place = best[window]
    hot = classes[place] >= rare.hot
    new = np.concatenate([[True], (np.diff(place) != 0) | (np.diff(window) != 1)]) | hot
    first = np.flatnonzero(new)
    counts = np.diff(np.concatenate([first, [len(window)]]))
    deal = grams[place[first]]
    if hot.any():
        single = hot[first]
        deal = np.where(single, window_hashes_of(words, k)[window[first]], deal)
    return window[first], counts, deal


def partition(docs: DataFrame, k: int, m: int, buckets: int, flush_bytes: int, rare: Rarity) -> DataFrame:
    """(bucket, kind, block): blocks of packed strings (kind 0), and of windows that a task itself found to repeat (kind 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(rare)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = shared.value
        held: list[tuple[bytes, int, int, int, int]] = []
        size = turn = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, turn
            earliest: dict[bytes, int] = {}
            held.sort(key=lambda x: (x[1], x[2]))
            chosen, repeats = [], []
            for i, row in enumerate(held):
                other = earliest.setdefault(row[0], i)
                if other == i or held[other][1:3] == row[1:3]:
                    chosen.append(i)
                else:
                    repeats.append(i)
            out: list[tuple[int, int, bytes]] = []
            if chosen:
                targets = np.array([held[i][4] for i in chosen], dtype=np.int64)
                for bucket, rows in by_bucket(targets):
                    picked = [held[chosen[r]] for r in rows.tolist()]
                    strings = [p[0] for p in picked]
                    numbers = [np.array([p[c] for p in picked], dtype=np.int64) for c in (1, 2, 3)]
                    sizes = np.array([len(s) for s in strings], dtype=np.int64)
                    out.append((bucket, 0, squeeze(*numbers, sizes, np.frombuffer(b"".join(strings), np.uint8))))
            if repeats:
                numbers = [np.array([held[i][c] for i in repeats], dtype=np.int64) for c in (1, 2, 3)]
                out.append((turn % buckets, 1, squeeze(*numbers)))
            held, size, turn = [], 0, turn + 1
            bucket, kind, block = zip(*out, strict=True) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(kind, pa.int32()), pa.array(block, pa.binary())], names=["bucket", "kind", "block"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = encoded(batch.column(1).to_pylist())
            joined, starts, ends, owner = normalised(texts)
            words = run_hashes(joined, starts, ends)
            first, counts, keys = super_kmers(words, owner, k, m, rare)
            raw = joined.tobytes()
            begins = np.searchsorted(owner, np.arange(len(ids)))
            left = starts[first].tolist()
            right = ends[first + counts + k - 2].tolist()
            of = owner[first]
            place = (first - begins[of]).tolist()
            targets = (keys % np.uint64(buckets)).tolist()
            if not turn and not held:
                turn = int(ids[0]) % buckets if ids and ids[0] is not None else 0
            for a, b, o, p, c, t in zip(left, right, of.tolist(), place, counts.tolist(), targets, strict=True):
                held.append((raw[a:b], ids[o], p, c, t))
                size += b - a
                if size > flush_bytes:
                    yield flush()
        if held:
            yield flush()

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, "bucket long, kind int, block binary")


def count_bucket(k: int):
    """The reducer of one bucket: spans of words in windows that also start earlier."""

    def run(group: pa.Table) -> pa.Table:
        kinds = group.column("kind").to_pylist()
        blocks = [spread_out(b) for b in group.column("block").to_pylist()]
        spans = [[b[c] for b, kind in zip(blocks, kinds, strict=True) if kind == 1] for c in range(3)]
        spans = [np.concatenate(s) if s else np.zeros(0, np.int64) for s in spans]
        doc, first, last = [spans[0]], [spans[1]], [spans[1] + spans[2] + k - 2]
        rows = [b for b, kind in zip(blocks, kinds, strict=True) if kind == 0]
        if rows:
            ids, place, counts, sizes = (np.concatenate([r[c] for r in rows]) for c in range(4))
            packed = np.concatenate([r[4] for r in rows]).tobytes()
            joined = b" ".join([packed[a:b] for a, b in _slices(sizes)]) + b" "
            raw = np.frombuffer(joined, np.uint8)
            ends = np.flatnonzero(raw == 32)
            starts = np.concatenate([[0], ends[:-1] + 1])
            words = run_hashes(raw, starts, ends)
            string_words = counts + k - 1
            base = np.cumsum(string_words) - string_words
            at = expand(base, counts)
            hashes = window_hashes_of(words, k)[at]
            of = np.repeat(np.arange(len(ids)), counts)
            start = expand(place, counts)
            order = np.lexsort((start, ids[of], hashes))
            h = hashes[order]
            same = np.concatenate([[False], h[1:] == h[:-1]])
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
            twin, own = order[head], order
            later = same & ((ids[of[own]] != ids[of[twin]]) | (start[own] != start[twin]))
            picked = np.flatnonzero(later)
            # Equal hashes are compared word by word: the windows' bytes decide.
            left, right = starts[at], ends[at + k - 1]
            a, b = own[picked], twin[picked]
            equal = [joined[p:q] == joined[r:s] for p, q, r, s in zip(left[a].tolist(), right[a].tolist(), left[b].tolist(), right[b].tolist(), strict=True)]
            if not all(equal):
                picked = _settle(joined, left, right, hashes, of, ids, start, order)
                found = np.sort(picked)
            else:
                found = np.sort(own[picked])
            if len(found):
                cut = np.concatenate([[True], (np.diff(found) != 1) | (np.diff(of[found]) != 0)])
                begin = np.flatnonzero(cut)
                stop = np.concatenate([begin[1:], [len(found)]]) - 1
                doc.append(ids[of[found[begin]]])
                first.append(start[found[begin]])
                last.append(start[found[stop]] + k - 1)
        return pa.table({"doc_id": np.concatenate(doc), "first": np.concatenate(first), "last": np.concatenate(last)})

    return run


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(sizes).tolist()
    return zip([0, *ends[:-1]], ends, strict=True)


def _settle(joined, left, right, hashes, of, ids, start, order) -> np.ndarray:
    """Windows that repeat an earlier one, where a hash stands for different words."""
    earliest: dict[bytes, int] = {}
    out = []
    for i in sorted(order.tolist(), key=lambda j: (ids[of[j]], start[j])):
        text = joined[left[i] : right[i]]
        other = earliest.setdefault(text, i)
        if (ids[of[other]], start[other]) != (ids[of[i]], start[i]):
            out.append(i)
    return np.array(out, dtype=np.int64)


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 20, m: int = 3, bucket_bytes: int = 8 << 20, flush_bytes: int = 12 << 20) -> DataFrame:
    """(doc_id, first, last): spans of words whose windows also start earlier. Spans may overlap."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull())
    size = text_bytes(rows)
    buckets = max(1, 3 * size // bucket_bytes)
    packed = partition(rows, k, m, buckets, flush_bytes, rarity(rows, m, slots_for(size)))
    # Partitions follow the bytes, so that a task's share stays the same.
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 3 * size // PARTITION_BYTES)
    return packed.repartition(parts, "bucket").groupBy("bucket").applyInArrow(count_bucket(k), SPANS)


def marked(intervals: list | None, n: int) -> np.ndarray:
    """Which of ``n`` places lie in one of the closed intervals."""
    steps = np.zeros(n + 1, dtype=np.int32)
    if intervals:
        pairs = np.array([(i["first"], i["last"]) for i in intervals], dtype=np.int64)
        pairs = np.minimum(pairs + [0, 1], n)
        np.add.at(steps, pairs[:, 0], 1)
        np.add.at(steps, pairs[:, 1], -1)
    return np.cumsum(steps[:n]) > 0


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True, **options) -> DataFrame:
    """Per document: ``n_words``, ``n_removed``, ``kept_sha256`` and, if asked for, ``kept_text``."""
    told, names = told_apart(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text")
    rows = told.select(F.col("__row").alias("doc_id"), "text")
    spans = repeated_spans(rows, "doc_id", "text", **options).groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    joined = compressed(rows).join(grown(spans), "doc_id", "left").select("doc_id", "packed_text", "spans")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if keep_text else "")
    labels = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, block, intervals in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = restored(block).split()
                n = len(words)
                if intervals:
                    gone = marked(intervals, n)
                    words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                kept = b" ".join(words)
                row = (key, n, n - len(words), hashlib.sha256(kept).hexdigest())
                out.append((*row, kept.decode("utf-8", "surrogatepass")) if keep_text else row)
            columns = list(zip(*out, strict=True)) or [()] * len(labels)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names=labels)

    return given_ids(joined.mapInArrow(run, schema), names, "doc_id")


def op4_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove repeated windows of 20 words from every whole text of ``documents``."""
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)
