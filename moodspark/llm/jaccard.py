"""N-gram Jaccard join with a token-group matrix, and its connected components.

Similar documents are put into groups: documents with one smallest shingle hash are a
family, a large family is dealt into chunks, and what a chunk joins is a group; every other
document is a group of its own. For each group the matrix stores the union of its
members' prefix tokens with the sizes of its smallest and largest set. A query group is
bounded by its overlap with that union; only groups whose bound reaches the threshold are
opened, that is, their texts are fetched and their members compared exactly. Only prefix
tokens are stored, since a set that is similar to another must share one of its first
tokens in any common order (Bayardo, Ma, Srikant, "Scaling up all pairs similarity
search", 2007); the order is rare tokens first, by counters over all documents.

Equal sets are one class: the smallest id stands for all. There are two ways to ask:

* ``similarity_components`` wants the components only. All chunks of a family hold the same few
  pivots, and every group is first compared with a leader, the first group of most of its
  tokens; so copies join over these, and groups that are one component already are not
  compared again. A family's work grows with its members, not with their pairs, and no link
  that could join two components is left out.
* ``similarity_links`` wants every link between different sets. It opens every bounded pair of
  groups and gives a row for each set with the list of its links; ``link_counts`` counts them.
  What it makes is as large as the links are many.

Letters A-Z are lower-cased, words are separated by white space. A text of fewer
words than a shingle is one shingle; null texts and texts without words have
none, link with nothing and are components of their own. For components each text
of an id that repeats is a document, with a result of its own, and so is each text
without an id; a component without any id has a null one. For all links
(``similarity_links``) ids that repeat count once (the smallest set hash, and of equal
sets the smallest hash of the text) and rows without an id are left out. An empty table gives an empty result; extra columns
are ignored. Shingles are told apart by 64-bit hashes, sets by 128-bit ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moodspark.llm.common import bound_batches, checked, discard, given_ids, grown, joined_by_key, materialise, smallest_of_key, table, told_apart
from moodspark.llm.components import components
from moodspark.llm.packing import restored, run_hashes, text_bytes, window_hashes_of
from moodspark.llm.sketch import frequency_classes, slots_for

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Members of a chunk besides the pivots, and pivots of a family of several chunks.
CHUNK, PIVOTS = 96, 3
#: Families of more members than this are dealt into chunks.
LARGE = 32
FILTER_BITS = 1 << 25


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    out = []
    for text in texts:
        words = text.translate(LOWER).split()
        if not words:
            out.append(np.zeros(0, dtype=np.uint64))
            continue
        joined = np.frombuffer(b" ".join(words) + b" ", np.uint8)
        ends = np.flatnonzero(joined == 32)
        starts = np.concatenate([[0], ends[:-1] + 1])
        out.append(np.unique(window_hashes_of(run_hashes(joined, starts, ends), min(size, len(words)))))
    return out


def encoded(values: list) -> list[bytes]:
    return [(v or "").encode("utf-8", "surrogatepass") for v in values]


def token_classes(rows: DataFrame, size: int) -> np.ndarray:
    """The frequency class of each counter, over all documents."""

    def tokens(batch: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *shingle_sets(encoded(batch.column(1).to_pylist()), size)])

    return frequency_classes(rows, tokens, slots_for(text_bytes(rows)))[0]


SIGNED = "doc_id long, set_hash binary, n_shingles long, text_hash long, family long, prefix array<long>"


def signatures(rows: DataFrame, size: int, percent: int, classes: np.ndarray) -> DataFrame:
    """The size and hash of each row's set, its smallest token and its rarest tokens."""
    shared = rows.sparkSession.sparkContext.broadcast(classes.tobytes())
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    labels = [c.split()[0] for c in SIGNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(shared.value, np.uint8)
        slot = np.uint64(len(known) - 1)
        for batch in batches:
            out = []
            sets = shingle_sets(encoded(batch.column(1).to_pylist()), size)
            for key, text_hash, tokens in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), sets, strict=True):
                n = len(tokens)
                if not n:
                    out.append((key, None, 0, text_hash, None, None))
                    continue
                keep = n - -(-percent * n // 100) + 1
                # Tokens are in order of hashes, so a stable order by class settles ties alike everywhere.
                prefix = tokens[np.argsort(known[(tokens & slot).astype(np.int64)], kind="stable")[:keep]]
                out.append((key, hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), n, text_hash, int(tokens[:1].view(np.int64)[0]), prefix.view(np.int64)))
            columns = list(zip(*out, strict=True)) or [()] * len(labels)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=labels)

    return rows.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, SIGNED)


class Matrix:
    """Members' sets over the tokens that at least two of them have, in blocks of columns."""

    COLUMNS = 1 << 14

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets])
        tokens = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        distinct, number, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        shared = counts > 1
        place = np.cumsum(shared) - 1
        use = shared[number]
        self.rows, self.columns = owner[use], place[number[use]]
        self.width = int(shared.sum())
        order = np.argsort(self.columns, kind="stable")
        self.rows, self.columns = self.rows[order], self.columns[order]

    def blocks(self) -> Iterator[np.ndarray]:
        for at in range(0, self.width, self.COLUMNS):
            lo, hi = np.searchsorted(self.columns, [at, at + self.COLUMNS])
            block = np.zeros((len(self.sizes), min(self.COLUMNS, self.width - at)), dtype=np.float32)
            block[self.rows[lo:hi], self.columns[lo:hi] - at] = 1
            yield block

    def inside(self) -> np.ndarray:
        """The intersection sizes of all members."""
        total = np.zeros((len(self.sizes),) * 2)
        for block in self.blocks():
            total += block @ block.T
        return total

    def union_overlap(self, queries: np.ndarray, group: np.ndarray) -> np.ndarray:
        """How many of each query's tokens are in the union of the group's sets: a row of the token-group matrix."""
        total = np.zeros(len(queries))
        for block in self.blocks():
            total += block[queries] @ block[group].max(axis=0)
        return total

    def across(self, queries: np.ndarray, group: np.ndarray) -> np.ndarray:
        total = np.zeros((len(queries), len(group)))
        for block in self.blocks():
            total += block[queries] @ block[group].T
        return total


def linked(shared: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether intersections reach the threshold, for row sizes ``a`` and column sizes ``b``."""
    return 100 * shared >= percent * (a[:, None] + b[None, :] - shared)


def unpacked(blocks: list[bytes], size: int) -> list[np.ndarray]:
    return shingle_sets([restored(b) for b in blocks], size)


LINKS = "a long, others array<long>, tree array<long>"
LONGS = pa.list_(pa.int64())


def forest(found: np.ndarray) -> list[tuple[int, int]]:
    """Places that keep the components of a link matrix: each member with one that was reached before it."""
    seen = np.zeros(len(found), dtype=bool)
    edges = []
    for root in range(len(found)):
        if seen[root]:
            continue
        seen[root] = True
        todo = [root]
        while todo:
            i = todo.pop()
            new = np.flatnonzero(found[i] & ~seen)
            seen[new] = True
            edges += [(i, j) for j in new.tolist()]
            todo += new.tolist()
    return edges


def link_table(found: np.ndarray, ids: list[int], every: bool) -> pa.RecordBatch:
    """Links of a symmetric link matrix: a row for each id with larger ids that it links with, each link once.

    ``tree`` are some that keep the components; ``others`` are all of them if ``every``, else none.
    """
    named = np.array(ids, dtype=np.int64)
    order = np.argsort(named)
    named, found = named[order], found[order][:, order]
    trees: dict[int, list[int]] = {}
    for i, j in forest(found):
        trees.setdefault(min(i, j), []).append(max(i, j))
    rows = np.flatnonzero(np.triu(found, 1).any(axis=1)).tolist() if every else sorted(trees)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(named[rows], pa.int64()),
            pa.array([named[i + 1 :][found[i, i + 1 :]] if every else [] for i in rows], LONGS),
            pa.array([named[trees.get(i, [])] for i in rows], LONGS),
        ],
        names=["a", "others", "tree"],
    )


def no_links() -> pa.RecordBatch:
    return link_table(np.zeros((0, 0), dtype=bool), [], False)


def join_group(size: int, percent: int, every: bool):
    """Links within one chunk and its pivots."""

    def run(group: pa.Table) -> pa.Table:
        kept = dict(zip(group.column("doc_id").to_pylist(), group.column("packed_text").to_pylist(), strict=True))
        matrix = Matrix(unpacked(list(kept.values()), size))
        return pa.Table.from_batches([link_table(linked(matrix.inside(), matrix.sizes, matrix.sizes, percent), list(kept), every)])

    return run


def open_groups(size: int, percent: int, every: bool):
    """Links between two groups: the queries of one whose bound with the other's union reaches the threshold are compared with its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = [no_links()]
            for left_ids, left, right_ids, right in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if len(left_ids) > len(right_ids):
                    left_ids, left, right_ids, right = right_ids, right, left_ids, left
                matrix = Matrix(unpacked(left + right, size))
                queries, members = np.arange(len(left)), np.arange(len(left), len(left) + len(right))
                bound = matrix.union_overlap(queries, members)
                smallest = matrix.sizes[members].min()
                # The union of two sets is no smaller than the larger one.
                opened = queries[100 * bound >= percent * np.maximum(matrix.sizes[queries], smallest)]
                if len(opened):
                    found = linked(matrix.across(opened, members), matrix.sizes[opened], matrix.sizes[members], percent)
                    square = np.zeros((len(opened) + len(members),) * 2, dtype=bool)
                    square[: len(opened), len(opened) :] = found
                    tables.append(link_table(square | square.T, [left_ids[i] for i in opened] + right_ids, every))
            yield from pa.Table.from_batches(tables).combine_chunks().to_batches()

    return run


def place_of(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)) + 1


def bitmap_of(values: DataFrame, column: str) -> Broadcast:
    """The values hashed into one bitmap of ``FILTER_BITS`` bits (4 MB), however many they are."""
    maps = values.select(place_of(column).alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in maps:
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        at = (r["bucket"] - 1) * len(part)
        bits[at : at + len(part)] = part
    return values.sparkSession.sparkContext.broadcast(bits.tobytes())


def in_bitmap(bits: np.ndarray, places: pa.Array) -> pa.Array:
    at = places.to_numpy() - 1
    return pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0)


def among(rows: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Leave out most rows whose ``column`` is not among the values, without a shuffle."""
    shared = bitmap_of(values, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            kept = batch.filter(in_bitmap(bits, batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays(kept.columns[:-1], names=batch.schema.names[:-1])

    return rows.withColumn("__place", place_of(column)).mapInArrow(run, rows.schema)


def wanted_only(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text_hash, packed_text) without most rows whose ``doc_id`` is not wanted, before their texts are shuffled.

    Rows that repeat an id and a text leave a task once.
    """
    shared = bitmap_of(wanted, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        press = zstandard.ZstdCompressor(level=3)
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            batch = batch.filter(in_bitmap(bits, batch.column(3)))
            new = []
            for key in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                new.append(key not in seen)
                seen.add(key)
            batch = batch.filter(pa.array(new, pa.bool_()))
            packed = [None if v is None else press.compress(v.encode("utf-8", "surrogatepass")) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary())], names=["doc_id", "text_hash", "packed_text"])

    return rows.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), place_of("doc_id").alias("place")).mapInArrow(run, "doc_id long, text_hash long, packed_text binary")


def fetched(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted``, which name a document's id and text hash, with the compressed texts."""
    met = wanted_only(rows, wanted).join(grown(wanted.withColumnRenamed("text_hash", "of_text")), "doc_id")
    return met.where(F.col("text_hash") == F.col("of_text")).dropDuplicates(["doc_id"]).drop("text_hash", "of_text")


def sizes_fit(percent: int) -> Column:
    """Whether some sets of ``a`` and ``b`` are near enough in size."""
    return (100 * F.col("most_a") >= percent * F.col("least_b")) & (100 * F.col("most_b") >= percent * F.col("least_a"))


def bounded_pairs(left: DataFrame, right: DataFrame, once: Column, by: list[str], percent: int) -> DataFrame:
    """The distinct ``by`` of pairs whose shared prefix tokens allow a link between their members.

    ``left`` and ``right`` have the token union of each group or set of groups, an entry a token, with the sizes of its
    smallest and largest sets (``least``, ``most``). All columns but the token get the ending ``_a`` or ``_b``; ``once``
    is a condition on them.

    If two sets link and one's prefix ends no later than the other's, all their common tokens in
    it are shared prefix tokens; the rest of it has ceil(t n) - 1 tokens. So they share at least
    t / (1 + t) (n_a + n_b) - ceil(t max(n_a, n_b)) + 1 prefix tokens.
    """
    side = lambda df, k: df.select("token", *(F.col(c).alias(f"{c}_{k}") for c in df.columns if c != "token"))
    met = side(left, "a").join(grown(side(right, "b")), "token").where(once & sizes_fit(percent))
    sizes = (F.min("least_a").alias("low_a"), F.min("least_b").alias("low_b"), F.max(F.greatest("most_a", "most_b")).alias("high"))
    need = F.ceil(F.lit(percent) * (F.col("low_a") + F.col("low_b")) / (100 + percent) - 1e-9) - F.ceil(F.lit(percent) * F.col("high") / 100 - 1e-9) + 1
    return met.groupBy(*by).agg(F.count("*").alias("shared"), *sizes).where(F.col("shared") >= need).select(*by)


def edges_of(links: DataFrame) -> DataFrame:
    return links.select("a", F.explode("tree").alias("b"))


def sets_of(docs: DataFrame, doc_id: str, text: str, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, ids, copies): the rows with an id, the set of each id, and the ids whose set an id below has too."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull())
    signed = signatures(rows, size, percent, token_classes(rows, size))
    best = F.min(F.struct(*(c.split()[0] for c in SIGNED.split(", ")[1:]))).alias("s")
    ids = materialise(signed.groupBy("doc_id").agg(best, F.count("*").alias("n_rows")).select("doc_id", "s.*", "n_rows"), "ids")
    copies = smallest_of_key(ids.where("n_shingles > 0").select("doc_id", "set_hash"), "set_hash", "doc_id")
    return rows, ids, materialise(copies.where(F.col("smallest") != F.col("doc_id")).select("doc_id", F.col("smallest").alias("class_id")), "copies")


def class_links(rows: DataFrame, ids: DataFrame, copies: DataFrame, size: int, percent: int, every: bool) -> DataFrame:
    """Links between the ids that stand for different sets, all if ``every``, else enough for their components."""
    kept: list[DataFrame] = []

    def written(df: DataFrame, name: str) -> DataFrame:
        """A table that goes when the links are there."""
        kept.append(materialise(df, name))
        return kept[-1]

    alone = ids.where("n_shingles > 0").join(checked(copies), "doc_id", "left_anti")

    # Large families are compared in chunks; for components the chunks share pivots.
    families = written(alone.groupBy("family").agg(F.count("*").alias("members")).where(F.col("members") > LARGE), "families")
    placed = alone.join(checked(families), "family", "left").select("doc_id", "text_hash", F.col("n_shingles").alias("n"), "prefix", "family", F.coalesce(F.ceil(F.col("members") / CHUNK), F.lit(0)).cast("int").alias("chunks"))
    placed = written(placed.withColumn("chunk", F.when(F.col("chunks") > 0, F.pmod(F.xxhash64("doc_id"), F.col("chunks"))).otherwise(-1).cast("int")), "families")
    members = materialise(fetched(rows, placed.where("chunks > 0").select("doc_id", "text_hash", "family", "chunk", "chunks")), "texts")
    chunked = members.select("doc_id", "family", "chunk", "packed_text")
    if not every:
        pivots = members.where("chunks > 1 and chunk = 0").groupBy("family").agg(F.slice(F.array_sort(F.collect_set("doc_id")), 1, PIVOTS).alias("ids")).select(F.explode("ids").alias("doc_id"))
        chunked = chunked.unionByName(members.join(grown(pivots), "doc_id").select("doc_id", "family", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "packed_text"))
    inner = materialise(chunked.groupBy("family", "chunk").applyInArrow(join_group(size, percent, every), LINKS), "links")
    discard(members)
    local = components(edges_of(inner))

    # The matrix: what one component has in one chunk is a group, every other document a group of its own.
    # A group has the name of its smallest member, and a key that groups of one component share.
    root = local.select(F.col("id").alias("doc_id"), "component")
    dealt = placed.where("chunks > 0").join(checked(local, root), "doc_id", "left")
    of_group = Window.partitionBy("component", "chunk")
    joined = dealt.where("component is not null").withColumn("group", F.min("doc_id").over(of_group))
    several = written(joined.select("doc_id", "text_hash", "n", "prefix", "group", F.col("group" if every else "component").alias("key")), "groups")
    ones = placed.where("chunks = 0").unionByName(dealt.where("component is null").select(placed.columns))
    ones = ones.select("doc_id", "text_hash", "n", "prefix", F.col("doc_id").alias("group"), F.col("doc_id").alias("key"))
    tokens = lambda df: df.select("group", "key", "n", F.explode("prefix").alias("token"))
    ends = lambda c, d: (F.min(c).alias("least"), F.max(d).alias("most"))
    entries = tokens(ones).select("token", "group", "key", F.col("n").alias("least"), F.col("n").alias("most")).unionByName(tokens(several).groupBy("token", "group", "key").agg(*ends("n", "n")))
    # Only tokens of several groups matter from here on; the first group of each leads it.
    lead = F.min(F.struct("group", "key", "least", "most")).alias("lead")
    shared = written(entries.groupBy("token").agg(lead, F.count("*").alias("groups")).where("groups > 1").select("token", "lead"), "tokens")
    entries = written(among(entries, "token", shared), "entries")
    homes = ones.unionByName(several).select("doc_id", "text_hash", "group")

    def opened(pairs: DataFrame, homes: DataFrame) -> DataFrame:
        """Links of the pairs of groups (group_a, group_b); ``homes`` has each document's group, of about a chunk's members at most."""
        use = pairs.select(F.col("group_a").alias("group")).union(pairs.select("group_b")).distinct()
        store = fetched(rows, homes.join(grown(use), "group", "left_semi"))
        blocks = materialise(store.groupBy("group").agg(F.collect_list(F.struct("doc_id", "packed_text")).alias("m")), "blocks")
        side = lambda k: grown(blocks.select(F.col("group").alias(f"group_{k}"), F.col("m.doc_id").alias(f"ids_{k}"), F.col("m.packed_text").alias(f"texts_{k}")))
        met = pairs.join(side("a"), "group_a").join(side("b"), "group_b")
        made = materialise(met.select("ids_a", "texts_a", "ids_b", "texts_b").mapInArrow(open_groups(size, percent, every), LINKS), "links")
        discard(blocks)
        return made

    if every:
        plain = entries.drop("key")
        pairs = bounded_pairs(plain, plain, F.col("group_a") < F.col("group_b"), ["group_a", "group_b"], percent)
        links = inner.unionByName(opened(written(pairs, "pairs"), homes))
        discard(*kept)
        return links

    # Single documents gather behind leaders: that of most of their tokens. Chunks of a leader's documents are compared like
    # those of a family, with some of the leader's own members as pivots. So near copies that no family holds together don't
    # meet pair by pair either, whether they link or just miss it.
    led = entries.select(*(F.col(c) if c == "token" else F.col(c).alias(f"{c}_b") for c in entries.columns)).join(grown(shared), "token")
    led = led.where("group_b = key_b").select("group_b", "least_b", "most_b", *(F.col(f"lead.{c}").alias(f"{c}_a") for c in ("group", "least", "most")))
    votes = led.where((F.col("group_a") != F.col("group_b")) & sizes_fit(percent)).groupBy("group_b", "group_a").agg(F.count("*").alias("votes"))
    first = written(votes.groupBy(F.col("group_b").alias("doc_id")).agg(F.max_by("group_a", F.struct("votes", -F.col("group_a"))).alias("leader")), "leaders")
    sizes = first.groupBy("leader").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    behind = ones.select("doc_id", "text_hash").join(checked(first), "doc_id").join(checked(first, sizes), "leader").select("doc_id", "text_hash", "leader", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int").alias("chunk"))
    heads = homes.join(checked(first, sizes.withColumnRenamed("leader", "group")), "group").groupBy("group", "chunks").agg(F.slice(F.array_sort(F.collect_list(F.struct("doc_id", "text_hash"))), 1, PIVOTS).alias("m"))
    heads = heads.select(F.explode("m").alias("m"), F.col("group").alias("leader"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).select("m.doc_id", "m.text_hash", "leader", "chunk")
    seats = written(behind.withColumn("own", F.lit(True)).unionByName(heads.withColumn("own", F.lit(False))), "seats")
    texts = fetched(rows, seats.select("doc_id", "text_hash").distinct())
    seated = seats.select("doc_id", "leader", "chunk").join(grown(texts), "doc_id")
    links = inner.unionByName(materialise(seated.groupBy("leader", "chunk").applyInArrow(join_group(size, percent, False), LINKS), "links"))
    reached = components(edges_of(links))

    # New groups: of a leader's chunk what is in one component, and what is in none; the key tells components apart.
    known = checked(reached, reached.withColumnRenamed("id", "doc_id"))
    spots = ones.select("doc_id").join(checked(seats, seats.where("own").select("doc_id", "leader", "chunk")), "doc_id", "left").join(known, "doc_id", "left")
    spots = spots.withColumns({"leader": F.coalesce("leader", "doc_id"), "chunk": F.coalesce("chunk", F.lit(-1))})
    moved = spots.select(F.col("doc_id").alias("group"), F.min("doc_id").over(Window.partitionBy("leader", "chunk", "component")).alias("to"), "component")
    stayed = several.select("group").distinct().join(checked(reached, reached.withColumnRenamed("id", "group")), "group").select("group", F.col("group").alias("to"), "component")
    moves = written(moved.unionByName(stayed), "moves")
    homes = homes.join(checked(moves, moves.select("group", "to")), "group").select("doc_id", "text_hash", F.col("to").alias("group"))
    keyed = entries.drop("key").join(checked(moves), "group").groupBy("token", F.col("to").alias("group"), F.col("component").alias("key")).agg(*ends("least", "most"))
    keyed = written(keyed, "entries")
    loose, tied = keyed.where("key is null").drop("key"), keyed.where("key is not null")
    wholes = tied.groupBy("token", "key").agg(*ends("least", "most"))
    # Loose groups meet once; tied ones meet loose ones and whole other components, so that one component's groups never meet.
    alone = bounded_pairs(loose, loose, F.col("group_a") < F.col("group_b"), ["group_a", "group_b"], percent)
    mixed = bounded_pairs(tied, loose, F.lit(True), ["group_a", "key_a", "group_b"], percent)
    half = written(bounded_pairs(tied, wholes, F.col("key_a") != F.col("key_b"), ["group_a", "key_a", "key_b"], percent), "bounded")
    back = half.select(F.col("group_a").alias("group_b"), F.col("key_b").alias("key_a"), F.col("key_a").alias("key_b"))
    both = half.where("key_a < key_b").join(checked(half, back), ["key_a", "key_b"])
    columns = ["group_a", "key_a", "group_b", "key_b"]
    unkeyed = F.lit(None).cast("long")
    pairs = alone.withColumns({"key_a": unkeyed, "key_b": unkeyed}).select(columns).unionByName(mixed.withColumn("key_b", unkeyed).select(columns)).unionByName(both.select(columns))
    pairs = written(pairs, "pairs")
    # Of two components one pair of groups first; then the pairs that this has not joined.
    one = pairs.where("key_b is not null").groupBy("key_a", "key_b").agg(F.min(F.struct("group_a", "group_b")).alias("s")).select("s.*")
    second = written(pairs.where("key_b is null").select("group_a", "group_b").unionByName(one), "pairs")
    links = links.unionByName(opened(second, homes))
    rest = pairs.where("key_b is not null").join(checked(second), ["group_a", "group_b"], "left_anti")
    if rest.isEmpty():
        discard(*kept)
        return links
    roots = components(edges_of(links))
    for k in "ab":
        rest = rest.join(checked(roots, roots.select(F.col("id").alias(f"key_{k}"), F.col("component").alias(f"root_{k}"))), f"key_{k}", "left")
    rest = written(rest.where(F.coalesce("root_a", "key_a") != F.coalesce("root_b", "key_b")).select("group_a", "group_b"), "pairs")
    if not rest.isEmpty():
        links = links.unionByName(opened(rest, homes))
    discard(*kept)
    return links


def similarity_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """(links, members): (a, others), the larger ids that an id which stands for its set links with, and (doc_id, n_shingles, class_id).

    Each link between different sets is there once; an id may have several rows. Documents of one ``class_id``
    have equal sets; those without words are classes of their own and link with nothing.
    """
    rows, ids, copies = sets_of(docs, doc_id, text, size, percent)
    links = class_links(rows, ids, copies, size, percent, every=True)
    members = ids.join(grown(copies), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"))
    return links.select("a", "others"), members


def link_counts(links: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, n_links): with how many other documents each one links, those with an equal set among them."""
    sizes = members.groupBy("class_id").agg(F.count("*").alias("size"))
    pairs = links.select("a", F.explode("others").alias("b"))
    both = pairs.select(F.col("a").alias("class_id"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    near = both.join(grown(sizes.select(F.col("class_id").alias("other"), "size")), "other").groupBy("class_id").agg(F.sum("size").alias("near"))
    counts = sizes.join(grown(near), "class_id", "left").select("class_id", (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    return joined_by_key(members, "class_id", "doc_id", counts).select("doc_id", "n_links")


def similarity_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest id reachable by links of at least ``percent`` % similarity.

    Of rows that repeat an id each text is a document; ``n_rows`` tells how many rows have it.
    """
    told, names = told_apart(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text")
    rows, ids, copies = sets_of(told.select("__row", "text"), "__row", "text", size, percent)
    reached = components(edges_of(class_links(rows, ids, copies, size, percent, every=False)))
    far = joined_by_key(copies, "class_id", "doc_id", reached.select(F.col("id").alias("class_id"), "component"))
    found = reached.withColumnRenamed("id", "doc_id").unionByName(far.select("doc_id", F.coalesce("component", "class_id").alias("component")))
    made = ids.join(grown(found), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), "n_rows")
    return given_ids(made, names, "doc_id", "component_id")


def op6_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` by 90 % similarity of three-word shingles."""
    return similarity_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
