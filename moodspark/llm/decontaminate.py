"""Benchmark decontamination with a BM25 index of the test items and block-max WAND.

The index holds test items, its queries are the passages of the training texts:
windows of twice the longest item's words, overlapping by half, so that every
copy of an item lies inside one. A score is the share of the item's own BM25
mass that the passage's words cover, 0 to 1. Block-max WAND retrieves every item
above the threshold; each retrieved pair is verified by the overlaps of the item's
question (its first two thirds) and answer (the rest): the share of their words that
lie in runs of five words which the passage has too. A changed word costs the runs
across it, so an item with one word in ten changed keeps most of both overlaps.

Items come to the executors in parts of at most ``part_bytes`` bytes of text, whatever
their number; a part's index is flat arrays, and one a worker process is kept. Document
frequencies and lengths are those of all items, so scores don't depend on the parts.

Words are runs of letters and digits, A-Z lower-cased, and are told apart by 64-bit hashes.
Null and empty texts and items match nothing; items without words are left out; an item of
fewer than five words is looked for as it stands; repeated items of one id count once (the
smallest text); items without an id are left out; repeated documents give repeated rows and
documents without an id rows without one; an empty table on either side gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodspark.llm.common import bound_batches, cached, field, map_column, materialise, table
from moodspark.llm.licenses import separated
from moodspark.llm.packing import expand, run_hashes, window_hashes_of

K1, B = 1.2, 0.75
BLOCK = 16
SHINGLE = 5
LEAST_WINDOW = 64
#: Words in more than this share of the items are common; the bound of a passage counts them as if all were there.
COMMON = 0.05


def word_hashes(text: str | None) -> np.ndarray:
    """The hash of each word of a text."""
    data = np.frombuffer(separated(text) + b" ", np.uint8) if text else np.zeros(0, np.uint8)
    apart = data == 32
    edges = np.flatnonzero(np.diff(apart.view(np.int8), prepend=np.int8(1)))
    return run_hashes(data, edges[::2], edges[1::2])


@dataclass(frozen=True)
class Statistics:
    """Of all items: their number, mean and greatest length, and the document frequencies of hashed words in order."""

    items: int
    mean: float
    longest: int
    words: np.ndarray
    spread: np.ndarray


def statistics_of(hashes: list[np.ndarray]) -> Statistics:
    words, spread = np.unique(np.concatenate([np.unique(h) for h in hashes] or [np.zeros(0, np.uint64)]), return_counts=True)
    lengths = [len(h) for h in hashes]
    return Statistics(len(hashes), sum(lengths) / max(1, len(hashes)), max(lengths, default=0), words, spread)


class Index:
    """Posting lists with normalised BM25 impacts, in blocks with their highest impact, all in flat arrays.

    The postings of word number t are those from ``start[t]`` to ``start[t + 1]``, its blocks those from
    ``block_start[t]`` on; words are numbered in the order of ``vocabulary``.
    """

    def __init__(self, items: list[tuple[int, str]], threshold: float, statistics: Statistics | None = None) -> None:
        kept = [(key, h) for key, text in sorted(items) if len(h := word_hashes(text))]
        self.keys = [key for key, _ in kept]
        self.threshold = threshold
        hashes = [h for _, h in kept]
        known = statistics or statistics_of(hashes)
        n = len(kept)
        self.window = max(LEAST_WINDOW, known.longest)
        self.lengths = np.array([len(h) for h in hashes], dtype=np.int64)
        self.item_start = np.concatenate([[0], np.cumsum(self.lengths)])
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.vocabulary, number = np.unique(every, return_inverse=True)
        size = max(1, len(self.vocabulary))
        pairs, counts = np.unique(number * np.int64(max(1, n)) + np.repeat(np.arange(n), self.lengths), return_counts=True)
        term, item = pairs // max(1, n), pairs % max(1, n)
        spread = known.spread[np.searchsorted(known.words, self.vocabulary)] if len(every) else np.zeros(0)
        norm = K1 * (1 - B + B * self.lengths / max(known.mean, 1e-9))
        raw = np.log(1 + (known.items - spread[term] + 0.5) / (spread[term] + 0.5)) * counts * (K1 + 1) / (counts + norm[item])
        impact = raw / np.bincount(item, raw, minlength=n)[item]
        start = np.searchsorted(term, np.arange(size + 1))
        sizes = np.diff(start)
        blocks = -(-sizes // BLOCK)
        first = np.repeat(start[:-1], blocks) + BLOCK * expand(np.zeros(size, np.int64), blocks)
        at = np.concatenate([[0], np.cumsum(blocks)])
        # Arrays of the standard library: their single elements are read faster than numpy's.
        self.items, self.impacts = array("q", item.tobytes()), array("d", impact.tobytes())
        self.start, self.block_start = array("q", start.astype(np.int64).tobytes()), array("q", at.astype(np.int64).tobytes())
        self.block_highest = array("d", (np.maximum.reduceat(impact, first) if len(first) else np.zeros(0)).tobytes())
        self.highest = array("d", (np.maximum.reduceat(impact, start[:-1]) if len(impact) else np.zeros(0)).tobytes())
        # For the bound of a passage: the rarer words' postings, and what they must add up to for each item.
        rare = (sizes <= max(2, COMMON * n))[term] if len(term) else np.zeros(0, bool)
        self.rare_start = np.concatenate([[0], np.cumsum(np.bincount(term[rare], minlength=size)), [0]])
        self.rare_start[-1] = self.rare_start[-2]
        self.rare_items, self.rare_impacts = item[rare], impact[rare]
        own = np.bincount(self.rare_items, self.rare_impacts, minlength=n) if n else np.zeros(0)
        self.rare_least = threshold - (1 - own) - 1e-9
        self.always = bool((self.rare_least <= 0).any())
        # The hash of each run of words of each item, at the place of its first word; short items are one run.
        self.run_length = np.minimum(self.lengths, SHINGLE)
        self.runs = np.zeros(len(every), np.uint64)
        for i, h in enumerate(hashes):
            made = window_hashes_of(h, int(self.run_length[i]))
            self.runs[self.item_start[i] : self.item_start[i] + len(made)] = made

    def windows(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Passages in which some item's rarer words, repeats counted, can reach the threshold with all its common words."""
        n, step = len(ids), self.window
        count = max(1, -(-(n - step) // step))
        if self.always:
            chosen = range(count)
        else:
            lengths = self.rare_start[ids + 1] - self.rare_start[ids]
            places = np.nonzero(lengths)[0]
            lengths = lengths[places]
            ends = np.cumsum(lengths)
            at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths) + np.repeat(self.rare_start[ids[places]], lengths)
            items, impacts = self.rare_items[at], self.rare_impacts[at]
            last = np.minimum(np.repeat(places // step, lengths), count - 1)
            both = last > 0
            keys, inverse = np.unique(np.concatenate([items * count + last, items[both] * count + last[both] - 1]), return_inverse=True)
            mass = np.bincount(inverse, np.concatenate([impacts, impacts[both]]), minlength=len(keys))
            chosen = np.unique(keys[mass >= self.rare_least[keys // count]] % count).tolist()
        for i in chosen:
            yield i * step, min(n, (i + 2) * step)

    def retrieve(self, terms: list[int]) -> list[tuple[int, float]]:
        """Every item whose score over ``terms`` reaches the threshold, by block-max WAND."""
        items, impacts, highest, blocks, start = self.items, self.impacts, self.highest, self.block_highest, self.start
        need, last = self.threshold - 1e-9, len(self.keys)
        at = {t: start[t] for t in terms}
        lists = list(terms)
        found = []
        while lists:
            lists.sort(key=lambda t: items[at[t]])
            bound, pivot = 0.0, None
            for k, t in enumerate(lists):
                bound += highest[t]
                if bound >= need:
                    pivot = k
                    break
            if pivot is None:
                break
            target = items[at[lists[pivot]]]
            while pivot + 1 < len(lists) and items[at[lists[pivot + 1]]] == target:
                pivot += 1
            within, boundary = 0.0, last
            for t in lists[: pivot + 1]:
                begin, end = start[t], start[t + 1]
                block = (at[t] - begin) // BLOCK
                while begin + block * BLOCK < end and (tail := items[min(end, begin + (block + 1) * BLOCK) - 1]) < target:
                    block += 1
                if begin + block * BLOCK < end:
                    within += blocks[self.block_start[t] + block]
                    boundary = min(boundary, tail + 1)
            if within < need:
                # No item up to the nearest block's end can qualify with these lists alone.
                goal = boundary
                if pivot + 1 < len(lists):
                    goal = min(goal, items[at[lists[pivot + 1]]])
                goal = max(goal, target + 1)
                moved = lists[: pivot + 1]
            elif items[at[lists[0]]] == target:
                score = sum(impacts[at[t]] for t in lists[: pivot + 1])
                if score >= need:
                    found.append((target, min(1.0, score)))
                goal, moved = target + 1, lists[: pivot + 1]
            else:
                goal, moved = target, [t for t in lists[: pivot + 1] if items[at[t]] < target]
            for t in moved:
                i, end = at[t], start[t + 1]
                while i < end and items[i] < goal:
                    i += 1
                at[t] = i
            lists = [t for t in lists if at[t] < start[t + 1]]
        return found

    def overlaps(self, item: int, passage: np.ndarray, seen: dict[int, np.ndarray]) -> tuple[float, float]:
        """The shares of the question's and the answer's words in runs that the passage has; ``seen`` keeps the passage's runs."""
        size, n, begin = int(self.run_length[item]), int(self.lengths[item]), int(self.item_start[item])
        if size not in seen:
            seen[size] = np.unique(window_hashes_of(passage, size))
        places = np.flatnonzero(np.isin(self.runs[begin : begin + n - size + 1], seen[size], assume_unique=False))
        steps = np.zeros(n + 1, dtype=np.int64)
        steps[places] += 1
        np.add.at(steps, places + size, -1)
        covered = np.cumsum(steps[:n]) > 0
        cut = -(-2 * n // 3)
        question = float(covered[:cut].mean())
        return question, float(covered[cut:].mean()) if cut < n else question

    def search(self, text: str | None) -> list[tuple[int, float, float, float]]:
        """(key, score, question overlap, answer overlap) of each item, over its best passage."""
        hashes = word_hashes(text)
        if not len(hashes) or not self.keys:
            return []
        unknown = len(self.vocabulary)
        ids = np.minimum(np.searchsorted(self.vocabulary, hashes), unknown - 1)
        ids[self.vocabulary[ids] != hashes] = unknown
        best: dict[int, tuple[float, float, float]] = {}
        for start, end in self.windows(ids):
            terms = np.unique(ids[start:end])
            seen: dict[int, np.ndarray] = {}
            for item, score in self.retrieve(terms[terms != unknown].tolist()):
                values = (score, *self.overlaps(item, hashes[start:end], seen))
                best[item] = max(best.get(item, (-1.0, 0.0, 0.0)), values, key=lambda x: (min(x[1:]), x))
        return [(self.keys[item], *values) for item, values in sorted(best.items())]


@dataclass(frozen=True)
class Part:
    """Some items with the statistics of all, under a name that worker processes keep its index by."""

    name: str
    items: list[tuple[int, str]]
    statistics: Statistics | None

    def index(self, threshold: float) -> Index:
        return cached(("bm25", threshold), lambda: Index(self.items, threshold, self.statistics), self.name)


def item_parts(items: DataFrame, item_id: str, item_text: str, part_bytes: int) -> Iterator[Part]:
    """The items in parts of about half of ``part_bytes`` bytes of text, at least one part."""
    clean = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).groupBy(F.col(item_id).cast("long").alias("k")).agg(F.min(item_text).alias("v"))
    total = clean.agg(F.sum(F.octet_length("v"))).first()[0] or 0
    parts = max(1, -(-2 * total // part_bytes))
    if parts == 1:
        yield Part(uuid.uuid4().hex, [(int(r["k"]), r["v"]) for r in clean.collect()], None)
        return
    clean = materialise(clean, "items")

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [word_hashes(v) for v in batch.column(1).to_pylist()]
            words = [np.unique(h) for h in made]
            rows = np.repeat(np.arange(len(made)), [len(w) for w in words])
            lengths = np.array([len(h) for h in made], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.concatenate(words).view(np.int64) if words else []), pa.array(lengths[rows])], names=["k", "word", "length"])

    words = materialise(clean.select("k", "v").mapInArrow(distinct_words, "k long, word long, length long"), "words")
    spread = materialise(words.groupBy("word").agg(F.count("*").alias("spread")), "spread")
    facts = words.groupBy("k").agg(F.max("length").alias("n")).agg(F.count("*").alias("items"), F.avg("n").alias("mean"), F.max("n").alias("longest")).first()
    for part in range(parts):
        mine = F.pmod(F.xxhash64("k"), F.lit(parts)) == part
        own = spread.join(words.where(mine).select("word").distinct(), "word").toPandas()
        hashes = own["word"].to_numpy(dtype=np.int64).view(np.uint64)
        order = np.argsort(hashes)
        known = Statistics(int(facts["items"]), float(facts["mean"] or 0), int(facts["longest"] or 0), hashes[order], own["spread"].to_numpy(dtype=np.int64)[order])
        yield Part(uuid.uuid4().hex, [(int(r["k"]), r["v"]) for r in clean.where(mine).collect()], known)


SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = 0.6,
    overlap: float = 0.5,
    verified: bool = True,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    part_bytes: int = 16 << 20,
) -> DataFrame:
    """Pairs of a document and an item in it; ``verified``: only those whose overlaps reach ``overlap``."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = None
    for part in item_parts(items, item_id, item_text, part_bytes):
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value.index(threshold)
            for batch in batches:
                out = [(key, *hit) for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in index.search(value)]
                columns = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        one = rows.mapInArrow(run, SCHEMA)
        found = one if found is None else found.unionByName(one)
    return found.where((F.col("question_overlap") >= overlap) & (F.col("answer_overlap") >= overlap)) if verified else found


def drop_leaking(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.5, text: str = "text", item_id: str = "item_id", item_text: str = "text", part_bytes: int = 16 << 20) -> DataFrame:
    """The documents in which no item is verified, in their columns; nothing is shuffled."""
    order = docs.columns
    for part in item_parts(items, item_id, item_text, part_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def run(values: list, shared=shared) -> list[pa.Array]:
            index = shared.value.index(threshold)
            return [pa.array([any(min(hit[2:]) >= overlap for hit in index.search(v)) for v in values], pa.bool_())]

        docs = map_column(docs, text, run, [field("__leaks", T.BooleanType())]).where(~F.col("__leaks")).select(*(f"`{c}`" for c in order))
    return docs


def op9_benchmark_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` against every item of ``benchmark``: one row per verified leak."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
