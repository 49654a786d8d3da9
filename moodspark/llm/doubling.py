"""Substring deduplication by distributed prefix doubling over UTF-8 bytes.

The name of a position at length h stands for the h bytes from there. Names at
twice the length are made from pairs: name_2h(p) from (name_h(p), name_h(p + h)).
Up to 64 bytes that is done where the text lies; from there on Spark sorts pairs of
ranks at growing offsets, and positions whose pair is unique drop out:

1. rank_64 of anchors. A window of ``length`` bytes has an anchor, the place with the smallest
   name_16 among its first ``length - 127`` ones, and equal windows have it in the same place.
   An anchor that is the only one of its rank drops out with all its windows.
2. (rank_64(p), rank_64(p + 64)) of the anchors that are left, of the second its first 32 bits: 128
   bytes, which all windows of an anchor have. Where the whole stretch of an anchor's windows repeats, all are removed;
   an anchor whose pair is unique drops out.
3. (rank_128(s), rank_128(s + length - 128)), as the name of the pair, of the windows of the anchors
   that are left, each stretch shown once: the whole length, past which nothing is asked. Unique
   pairs drop out, all others are removed.

Ranks are not renumbered densely: a rank is the 64-bit name itself, so rows of one hot rank
need not meet to get a number. Of each rank a task sends one row to the sort; what a task itself
knows to repeat, it sends on to the next round. What is removed is equal in 128 bits: the name of
all its bytes and a second hash of them that is made in another way.

Sorting every byte's position would move at least 24 bytes a byte of text at each offset;
anchors are about one position in 35, and few of their windows are looked at.

Null and empty texts have no bytes. Rows that repeat an id and a text hold the same
strings at the same places, which don't count as other places; different
texts of one id are documents of their own, and rows without an id, told apart by their texts, are kept. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodspark.llm.common import bound_batches, cached, discard, given_ids, grown, materialise, reclaim, table, told_apart
from moodspark.llm.packing import BYTE_NUMBERS, ODD, ODD_INVERSE, compressed, expand, mix, powers, restored, spread_out, squeeze, text_bytes
from moodspark.llm.superkmers import marked

GRAM, HALF, RANKED = 16, 64, 128
LEAST_LENGTH = 152
MULTIPLIER = np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes of text that are named at once; longer documents are cut into overlapping pieces.
PIECE = 1 << 20
#: Bytes of text for each partition of the sorts.
PARTITION_BYTES = 32 << 20
#: What a row is: removed bytes; an anchor for the first or the second sort; windows to look at.
REMOVED, FIRST, SECOND, LOOK = range(4)
#: What is known of a row: its stretch repeats, its 128 bytes do, its 64 bytes do.
REPEATS, MIXED_128, MIXED_64 = 4, 8, 16
ANCHORS = "a long, b int, stretch long, check long, doc_id long, first long, meta long"
FOUND = "doc_id long, first long, last long, probe int"
WINDOWS = "pair long, check long, doc_id long, place long, meta long"


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The names of pairs of names."""
    return mix(a * MULTIPLIER + b)


def names(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names at 16, 64 and 128 bytes of all positions that have as many.

    In between a product, a sum and a shift tell pairs apart; what is kept is mixed in full.
    """
    name = BYTE_NUMBERS[data]
    h, kept = 1, {}
    while h < RANKED:
        if len(name) > h:
            made = name[:-h] * MULTIPLIER
            made += name[h:]
            made ^= made >> np.uint64(32)
            name = made
        else:
            name = name[:0]
        h *= 2
        if h in (GRAM, HALF, RANKED):
            kept[h] = mix(name)
    return kept[GRAM], kept[HALF], kept[RANKED]


class Sums:
    """A hash of any stretch of bytes from running sums, apart from the names."""

    def __init__(self, data: np.ndarray) -> None:
        limit = PIECE + 2 * RANKED  # what a pack has at most
        up, self.down = cached("powers", lambda: (powers(ODD, limit), powers(ODD_INVERSE, limit)), str(limit))
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(BYTE_NUMBERS[data] * up[: len(data)], out=self.sums[1:])

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The hash of the bytes from ``first`` up to but not including ``last``."""
        return mix((self.sums[last] - self.sums[first]) * self.down[first] + (last - first).astype(np.uint64))


def anchors(gram: np.ndarray, owner: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, its first window, its windows): the leftmost smallest gram of each window's first ``span``.

    ``owner`` has a number for each window, below 0 where there is none; an anchor's windows have one owner.
    """
    windows = len(owner)
    none = np.zeros(0, dtype=np.int64)
    if not (owner >= 0).any():
        return none, none, none
    value = gram[: windows + span - 1]
    low, width = value, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:windows], low[span - width : span - width + windows])
    # Windows with one smallest value in a row are a stretch; in it each window's anchor is the first place from its
    # start on that has the value. Places are numbered by value and place, so one search finds them for all stretches.
    change = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])]))
    stops = np.concatenate([change[1:], [windows]])
    real = owner[change] >= 0
    change, stops = change[real], stops[real]
    distinct, number = np.unique(low[change], return_inverse=True)
    spot = np.searchsorted(distinct, value)
    spot[spot == len(distinct)] = 0
    places = np.flatnonzero(distinct[spot] == value)
    codes = np.sort(spot[places] * np.int64(len(value)) + places)
    head = np.searchsorted(codes, number * np.int64(len(value)) + change)
    tail = np.searchsorted(codes, number * np.int64(len(value)) + stops - 1)
    counts = tail - head + 1
    which = expand(head, counts)
    place = codes[which] % len(value)
    start = np.repeat(change, counts)
    first = np.where(which == np.repeat(head, counts), start, np.concatenate([[0], place[:-1]]) + 1)
    after = np.minimum(place, np.repeat(stops, counts) - 1)
    return place, first, after - first + 1


@dataclass
class Pack:
    """Pieces of documents side by side: the key and the offset in its document of each, where it begins, and all bytes."""

    keys: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    data: np.ndarray

    def owners(self, length: int) -> np.ndarray:
        """The piece of each window, -1 for those that cross an edge."""
        sizes = np.diff(np.append(self.starts, len(self.data)))
        ends = self.starts + np.maximum(sizes - length + 1, 0)
        steps = np.zeros(len(self.data) + 1, dtype=np.int64)
        inside = sizes >= length
        steps[self.starts[inside]] += 1
        steps[ends[inside]] -= 1
        owner = np.repeat(np.arange(len(sizes)), sizes)
        return np.where(np.cumsum(steps[:-1]) > 0, owner, -1)[: max(0, len(self.data) - length + 1)]


def packs(rows: Iterable[tuple[int, bytes]], length: int) -> Iterator[Pack]:
    """Documents of at least ``length`` bytes, in packs of about ``PIECE`` bytes; pieces overlap by one window less a byte."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def made() -> Pack:
        keys, offsets, parts = zip(*held, strict=True)
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        return Pack(np.array(keys, dtype=np.int64), np.array(offsets, dtype=np.int64), np.cumsum(sizes) - sizes, np.frombuffer(b"".join(parts), np.uint8))

    for key, data in rows:
        for at in range(0, len(data) - length + 1, PIECE):
            piece = data[at : at + PIECE + length - 1]
            if held and size + len(piece) > PIECE:
                yield made()
                held, size = [], 0
            held.append((key, at, piece))
            size += len(piece)
    if held:
        yield made()


def encoded(value: str | None) -> bytes:
    return (value or "").encode("utf-8", "surrogatepass")


def signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64))


def batch_of(schema: str, columns: list[np.ndarray]) -> pa.RecordBatch:
    kinds = dict(c.split() for c in schema.split(", "))
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)) if kind == "int" else signed(c) for c, kind in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any of the columns; the first one does."""
    new = np.zeros(len(columns[0]), dtype=bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    new[:1] = True
    return new


def in_order(name: np.ndarray, other: np.ndarray) -> np.ndarray:
    """A stable order by name and, where equal names have several, by the other column."""
    order = np.argsort(name, kind="stable")
    a, b = name[order], other[order]
    return np.lexsort((other, name)) if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any() else order


def repeats(new: np.ndarray, ids: np.ndarray, place: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group of each row, first row of each group, whether a group is in two places or known to be); ``new`` marks first rows."""
    group = np.cumsum(new) - 1
    lead = np.flatnonzero(new)
    other = (ids != ids[lead][group]) | (place != place[lead][group]) | known
    return group, lead, np.bincount(group, other, minlength=len(lead)) > 0


def anchor_rows(docs: DataFrame, length: int, flush_rows: int) -> DataFrame:
    """Anchors for the sorts, one a rank and task, and what the task itself knows."""
    span = length - RANKED + 1

    def flush(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        a, b, stretch, check, doc, first, counts = (np.concatenate(c) for c in zip(*held, strict=True))
        # Of equal stretches in one task, one travels: the one that stands first, marked as repeated.
        order = in_order(stretch, check)
        new = changes(stretch[order], check[order])
        group, lead, repeated = repeats(new, doc[order], first[order], np.zeros(len(order), bool))
        gone = order[repeated[group]]
        lead = order[lead]
        meta = np.where(repeated, REPEATS, 0)
        # Of equal 128 bytes one is sorted, and of equal 64 bytes one in the first round; the others are known to repeat.
        at = in_order(a[lead], b[lead])
        lead, meta = lead[at], meta[at]
        new_128 = changes(a[lead], b[lead])
        pair_of = np.cumsum(new_128) - 1
        heads = np.flatnonzero(new_128)
        new_64 = changes(a[lead[heads]])
        half_of = np.cumsum(new_64) - 1
        several_128 = np.bincount(pair_of) > 1
        several_64 = np.bincount(half_of, several_128 | ~new_64) > 0
        meta += np.where(several_128[pair_of], MIXED_128, 0) + np.where(several_64[half_of][pair_of], MIXED_64, 0)
        kind = np.full(len(lead), LOOK)
        kind[heads] = np.where(new_64, FIRST, SECOND)
        meta += kind + counts[lead] * 32
        last = first[gone] + counts[gone] + length - 2
        columns = [c[lead] for c in (a, b, stretch, check, doc, first)]
        zero = np.zeros(len(gone), dtype=np.uint64)
        spans = [zero, zero.astype(np.int32), last.astype(np.uint64), zero, doc[gone], first[gone]]
        return batch_of(ANCHORS, [*(np.concatenate(c) for c in zip(columns, spans, strict=True)), np.concatenate([meta, np.full(len(gone), REMOVED)])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            for pack in packs(zip(batch.column(0).to_pylist(), map(encoded, batch.column(1).to_pylist()), strict=True), length):
                gram, half, ranked = names(pack.data)
                owner = pack.owners(length)
                place, first, counts = anchors(gram, owner, span)
                last = first + counts - 1
                whole = lambda s: pair(ranked[s], ranked[s + length - RANKED])
                shape = mix((place - first).astype(np.uint64) * np.uint64(256) + counts.astype(np.uint64))
                stretch = pair(pair(whole(first), whole(last)), shape)
                of = owner[first]
                begin = first - pack.starts[of] + pack.offsets[of]
                held.append([half[place], (half[place + HALF] >> np.uint64(32)).astype(np.uint32).view(np.int32), stretch, Sums(pack.data).of(first, last + length), pack.keys[of], begin, counts])
                size += len(place)
                if size > flush_rows:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, ANCHORS)


def whole_groups(batches: Iterator[pa.RecordBatch], new: Callable[[list[np.ndarray]], np.ndarray]) -> Iterator[list[np.ndarray]]:
    """The columns of sorted rows, cut between groups only; ``new`` marks the first rows of groups.

    A group has at most a row for each flush of a task, so what is held is small.
    """
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(c) for c in zip(held, columns, strict=True)]
        if not len(columns[0]):
            continue
        at = int(np.flatnonzero(new(columns))[-1])
        if at:
            yield [c[:at] for c in columns]
        held = [c[at:] for c in columns]
    if held is not None:
        yield held


def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors in order of rank: those that are the only ones of theirs go; all other rows pass."""
    for columns in whole_groups(batches, lambda c: changes(c[6] & 3, c[0])):
        a, meta = columns[0], columns[6]
        group = np.cumsum(changes(meta & 3, a)) - 1
        shared = (np.bincount(group) > 1) | (np.bincount(group, meta & MIXED_64) > 0)
        mine = (meta & 3) == FIRST
        keep = ~mine | shared[group]
        columns[6] = meta + np.where(mine, SECOND - FIRST, 0)
        yield batch_of(ANCHORS, [c[keep] for c in columns])


def second_round(length: int):
    """Anchors in order of their pairs of ranks: repeated stretches are removed (probe 0), of what else shares its pair the windows are looked at.

    Probe 1 are the windows of a stretch that is the only one of its kind, probe 2 those of one representative of a repeated stretch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, stretch, check, ids, begin, meta in whole_groups(batches, lambda c: changes(c[0], c[1])):
            counts, known = meta // 32, (meta & REPEATS) > 0
            new_pair = changes(a, b)
            group, lead, repeated = repeats(new_pair | changes(stretch, check), ids, begin, known)
            gone = repeated[group] & ~known
            pairs = np.cumsum(new_pair) - 1
            shared = (np.bincount(pairs[lead]) > 1) | (np.bincount(pairs, meta & MIXED_128) > 0)
            look = lead[shared[pairs[lead]]]
            mark = np.where(repeated[group[look]], 2, 1)
            first, last = (np.concatenate(c) for c in ((begin[gone], begin[look]), ((begin + counts + length - 2)[gone], (begin + counts - 1)[look])))
            yield pa.RecordBatch.from_arrays([signed(np.concatenate([ids[gone], ids[look]])), signed(first), signed(last), pa.array(np.concatenate([np.zeros(gone.sum(), np.int32), mark.astype(np.int32)]))], names=["doc_id", "first", "last", "probe"])

    return run


def third_round(length: int):
    """Windows in order of their pairs of ranks: those that share all with another place are removed, if that is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, check, ids, place, meta in whole_groups(batches, lambda c: changes(c[0], c[1])):
            group, _, repeated = repeats(changes(name, check), ids, place, (meta & REPEATS) > 0)
            i = np.flatnonzero(repeated[group] & ((meta & 1) > 0))
            yield batch_of("doc_id long, first long, last long", [ids[i], place[i], place[i] + length - 1])

    return run


def cut(data: bytes, intervals: list | None) -> tuple[bytes, int]:
    """The bytes outside the intervals, and how many maximal runs went."""
    if not intervals or not data:
        return data, 0
    gone = marked(intervals, len(data))
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), runs


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def result_row(key: int, data: bytes, intervals: list | None) -> tuple[int, int, int, int, str, bytes]:
    kept, runs = cut(data, intervals)
    return key, len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept


def window_rows(texts: list[tuple[int, bytes]], probes: list[tuple[np.ndarray, np.ndarray]], length: int) -> tuple[bytes, bytes | None] | None:
    """The windows of some documents that are to be sorted, and the spans of those that repeat among them, packed.

    ``probes`` has the places of each document's windows in order, and whether they may be removed.
    """
    looks = []
    doc_ids = np.array([key for key, _ in texts], dtype=np.int64)
    for pack in packs(enumerate(data for _, data in texts), length):
        ranked, sums = names(pack.data)[2], Sums(pack.data)
        ends = np.append(pack.starts[1:], len(pack.data))
        for number, offset, start, end in zip(pack.keys.tolist(), pack.offsets.tolist(), pack.starts.tolist(), ends.tolist(), strict=True):
            at, wanted = probes[number]
            lo, hi = np.searchsorted(at, [offset, min(offset + PIECE, offset + end - start - length + 1)])
            where = at[lo:hi] - offset + start
            looks.append((pair(ranked[where], ranked[where + length - RANKED]), sums.of(where, where + length), np.full(hi - lo, doc_ids[number]), at[lo:hi], wanted[lo:hi]))
    if not looks:
        return None
    name, check, ids, place, wanted = (np.concatenate(c) for c in zip(*looks, strict=True))
    order = in_order(name, check)
    name, check, ids, place, wanted = (c[order] for c in (name, check, ids, place, wanted))
    # Of equal windows in one batch, one travels.
    group, lead, repeated = repeats(changes(name, check), ids, place, np.zeros(len(name), bool))
    asked = np.bincount(group, wanted)[: len(lead)] > 0
    meta = np.where(repeated, REPEATS, 0) + np.where(asked & ~repeated, 1, 0)
    gone = np.flatnonzero(repeated[group] & (wanted > 0))
    back = np.lexsort((place[lead], ids[lead]))
    i = lead[back]
    block = squeeze(name[i], check[i], ids[i], place[i], meta[back].astype(np.uint8))
    gone = gone[np.lexsort((place[gone], ids[gone]))]
    return block, squeeze(ids[gone], place[gone]) if len(gone) else None


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200, keep_bytes: bool = True, flush_rows: int = 400_000) -> DataFrame:
    """Per document the bytes that no string of ``length`` bytes, which also starts elsewhere, covers.

    Columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (binary).
    ``flush_rows``: anchors that a task holds at once.
    """
    if not LEAST_LENGTH <= length <= 2 * RANKED:
        raise ValueError(f"length must be from {LEAST_LENGTH} to {2 * RANKED}")
    told, names = told_apart(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text")
    rows = told.select(F.col("__row").alias("doc_id"), "text")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), text_bytes(rows) // PARTITION_BYTES)
    kind = F.col("meta").bitwiseAND(3)

    # Round 1. What is no anchor of this round is dealt out by its place and passes.
    dealt = F.when(kind == FIRST, F.col("a")).otherwise(F.xxhash64("doc_id", "first"))
    sorted_64 = anchor_rows(rows, length, flush_rows).repartition(parts, dealt).sortWithinPartitions(kind, "a")
    ranked = materialise(sorted_64.mapInArrow(first_round, ANCHORS), "ranked")
    reclaim(rows.sparkSession)
    # Round 2.
    sorted_128 = ranked.where(kind == SECOND).repartition(parts, "a", "b").sortWithinPartitions("a", "b", "stretch", "check", "doc_id", "first")
    found = sorted_128.mapInArrow(second_round(length), FOUND)
    repeated = F.col("meta").bitwiseAND(REPEATS) > 0
    gone = ranked.where(kind == REMOVED).select("doc_id", "first", F.col("stretch").alias("last"), F.lit(0).alias("probe"))
    look = ranked.where(kind == LOOK).select("doc_id", "first", (F.col("first") + F.shiftright("meta", 5) - 1).alias("last"), F.when(repeated, 2).otherwise(1).alias("probe"))
    spans = F.struct("first", "last")
    lists = found.unionByName(gone).unionByName(look).groupBy("doc_id").agg(*(F.collect_list(F.when(F.col("probe") == k, spans)).alias(f"p{k}") for k in range(3)))
    joined = compressed(rows).join(grown(lists), "doc_id", "left").select("doc_id", "packed_text", "p0", "p1", "p2")

    span_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    wide = RESULT + ", kept binary, packed_text binary, p0 array<struct<first:long,last:long>>, windows binary, known binary"
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary(), span_type, pa.binary(), pa.binary()]
    labels = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "packed_text", "p0", "windows", "known"]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents without windows to look at are done; the others keep their text and give the ranks of windows."""
        for batch in batches:
            out, texts, probes = [], [], []
            for key, block, gone, own, shown in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                data = restored(block)
                if not own:
                    row = result_row(key, data, gone)
                    out.append((*row[:5], row[5] if keep_bytes else None, None, None, None, None))
                else:
                    out.append((key, None, None, None, None, None, block, gone, None, None))
                looked = [(p["first"], p["last"], 1) for p in own or ()] + [(p["first"], p["last"], 0) for p in shown or ()]
                if looked:
                    begin, end, wanted = (np.array(c, dtype=np.int64) for c in zip(*sorted(looked), strict=True))
                    counts = end - begin + 1
                    at, wanted = expand(begin, counts), np.repeat(wanted, counts).astype(np.uint8)
                    order = np.argsort(at, kind="stable")
                    probes.append((at[order], wanted[order]))
                    texts.append((key, data))
            if made := window_rows(texts, probes, length):
                out.append((None,) * 8 + made)
            columns = list(zip(*out, strict=True)) or [()] * len(labels)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=labels)

    half = materialise(joined.mapInArrow(settle, wide), "settled")
    discard(ranked)
    reclaim(rows.sparkSession)
    outcome = [c.split()[0] for c in RESULT.split(", ")] + (["kept"] if keep_bytes else [])
    done = half.where(F.col("kept_sha256").isNotNull()).select(*outcome)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                yield batch_of(WINDOWS, spread_out(block))

    def unpack_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                ids, place = spread_out(block)
                yield batch_of("doc_id long, first long, last long", [ids, place, place + length - 1])

    # Round 3.
    windows = half.where(F.col("windows").isNotNull()).select("windows").mapInArrow(unpack, WINDOWS)
    sorted_windows = windows.repartition(parts, "pair").sortWithinPartitions("pair", "check", "doc_id", "place")
    known = half.where(F.col("known").isNotNull()).select("known").mapInArrow(unpack_known, "doc_id long, first long, last long")
    more = sorted_windows.mapInArrow(third_round(length), "doc_id long, first long, last long").unionByName(known).groupBy("doc_id").agg(F.collect_list(spans).alias("p1"))
    waiting = half.where(F.col("packed_text").isNotNull()).select("doc_id", "packed_text", "p0").join(grown(more), "doc_id", "left").select("doc_id", "packed_text", "p0", "p1")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [result_row(key, restored(block), (a or []) + (b or [])) for key, block, a, b in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)]
            columns = list(zip(*out, strict=True)) or [()] * 6
            width = len(outcome)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:width], kinds[:width], strict=True)], names=outcome)

    return given_ids(done.unionByName(waiting.mapInArrow(finish, RESULT + (", kept binary" if keep_bytes else ""))), names, "doc_id")


def op5_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove repeated strings of 200 bytes from every whole text of ``documents``."""
    return remove_repeats(table(spark, sf_dir, "documents"), keep_bytes=False)
