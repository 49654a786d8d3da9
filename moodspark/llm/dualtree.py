"""Hard negatives of labelled vectors: dual-tree search for the largest inner products.

Vectors are integers: each component is scaled and floored, so scores are exact and ties are real. A tree of cuts along
principal axes, fitted on a bounded sample, deals all rows into cells; the rows of a cell are packed into chunks of at
most ``CHUNK`` rows, the anchors of a cell into groups of at most ``GROUP``. Chunks and groups hold their rows in the
order of a balanced tree (first by label, then along principal axes), whose nodes know their ball, their box and
their labels. The fit decides where rows lie, never what is found.

A search runs in two rounds. In the first a group meets the chunks of its own cell; what it finds bounds the second, in
which a group goes only to those cells whose inner products with the whole group can reach one of its bounds: the
interval of two balls. There, group and chunk trees are walked together: the intervals of a pair of nodes (balls, boxes,
norms, labels) prune all their anchors and rows at once, pairs of leaves are scored exactly. Each anchor has slots, each
with the largest and the smallest score it can use; positives are one slot over rows of the same label, negatives a slot
for each positive over the rows of other labels.

Groups and chunks meet by a join on (cell, part). The rows of a cell are dealt over parts of about a chunk, so a cell
with a third of all rows is many keys. Best lists merge by (anchor, slot, cell) and then by (anchor, slot). What is
broadcast is the tree: ``MOST_CELLS`` cells at most.

Rows without id, label or vector, with a null or non-finite component, or with a scaled one beyond ``LARGEST`` (whose
products may not fit a 64-bit score) take no part. Shorter vectors count as if zeros followed; vectors longer than
``MOST_DIMENSIONS`` are an error, as their scores may not fit either. Rows that repeat an id, even in everything, are rows
of their own: an anchor's other rows are all but one like itself, and an anchor that is there twice has its results
twice. An empty table, or one without anchors, gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodspark.llm.common import bound_batches, discard, grown, materialise, table

#: Rows of a chunk, of a leaf of its tree, anchors of a group, and of a leaf of its tree.
CHUNK, LEAF, GROUP, ANCHOR_LEAF = 2048, 128, 512, 32
MOST_CELLS = 1024
#: Rows, and components of them, that the cuts are fitted on at most.
SAMPLE, SAMPLE_COMPONENTS = 20_000, 2_000_000
#: With components and dimensions up to these a score fits 63 bits.
LARGEST, MOST_DIMENSIONS = 1 << 26, 2047
#: Sums of products below this are exact in double precision.
EXACT = 1 << 53
LOWEST, HIGHEST = -(1 << 62), 1 << 62
ROWS = "cell int, part int, label long, id long, vector binary"
PACKED = "cell int, part int, number long, n int, width int, ids binary, labels binary, vectors binary, center binary, radius double"
FOUND = "number long, at int, slot int, cell int, anchor_id long, own long, best array<struct<score:long,tie:long>>"


class Cuts:
    """A balanced tree of cuts by principal axes; ``cells`` gives the leaf of each row of a matrix."""

    def __init__(self, sample: np.ndarray, n_cells: int) -> None:
        self.nodes: list[tuple[np.ndarray, float, int, int] | None] = []
        self.leaves: list[np.ndarray] = []
        self._cut(sample, n_cells)
        self.centers = np.array(self.leaves)

    def _cut(self, points: np.ndarray, n_cells: int) -> int:
        """Add a subtree; its place, or for a leaf the complement of the cell's number."""
        if n_cells <= 1 or len(points) < 2:
            self.leaves.append(points.mean(axis=0) if len(points) else np.zeros(points.shape[1]))
            return ~(len(self.leaves) - 1)
        axis = principal_axis(points)
        along = points @ axis
        middle = float(np.quantile(along, (n_cells // 2) / n_cells))
        low = along <= middle
        at = len(self.nodes)
        self.nodes.append(None)
        left = self._cut(points[low], n_cells // 2)
        self.nodes[at] = (axis, middle, left, self._cut(points[~low], n_cells - n_cells // 2))
        return at

    def cells(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), dtype=np.int32)
        stack = [(0 if self.nodes else ~0, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                out[rows] = ~node
            elif len(rows):
                axis, middle, left, right = self.nodes[node]
                low = points[rows] @ axis <= middle
                stack += [(left, rows[low]), (right, rows[~low])]
        return out


def principal_axis(points: np.ndarray) -> np.ndarray:
    """The direction in which points spread most."""
    return np.linalg.eigh(np.cov(points, rowvar=False).reshape(points.shape[1], -1))[1][:, -1]


def tree_order(points: np.ndarray, labels: np.ndarray, leaf: int) -> np.ndarray:
    """An order in which the halves of the rows, their halves and so on are the nodes of a tree."""
    order = np.arange(len(points))
    stack = [(0, len(points))]
    while stack:
        start, stop = stack.pop()
        rows = order[start:stop]
        if len(np.unique(labels[rows])) > 1:
            rows = rows[np.argsort(labels[rows], kind="stable")]
        elif stop - start > leaf:
            rows = rows[np.argsort(points[rows] @ principal_axis(points[rows]), kind="stable")]
        order[start:stop] = rows
        if stop - start > leaf:
            middle = (start + stop) // 2
            stack += [(start, middle), (middle, stop)]
    return order


class Tree:
    """A packed chunk or group as a tree over its rows."""

    def __init__(self, n: int, width: int, ids: bytes, labels: bytes, vectors: bytes, leaf: int) -> None:
        self.ids, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        self.whole = np.frombuffer(vectors, f"<i{width}").reshape(n, -1)
        self.points = self.whole.astype(np.float64)
        self.spans: list[tuple[int, int]] = [(0, n)]
        self.children: list[tuple[int, int] | None] = []
        for start, stop in self.spans:  # grows as it is read
            if stop - start > leaf:
                middle = (start + stop) // 2
                self.children.append((len(self.spans), len(self.spans) + 1))
                self.spans += [(start, middle), (middle, stop)]
            else:
                self.children.append(None)
        parts = [self.points[a:b] for a, b in self.spans]
        self.low, self.high = np.array([p.min(axis=0) for p in parts]), np.array([p.max(axis=0) for p in parts])
        self.center = np.array([p.mean(axis=0) for p in parts])
        self.radius = np.array([np.sqrt(((p - c) ** 2).sum(axis=1).max()) for p, c in zip(parts, self.center, strict=True)])
        self.norm = np.array([np.sqrt((p**2).sum(axis=1).max()) for p in parts])
        self.first_label = np.array([self.labels[a:b].min() for a, b in self.spans])
        self.last_label = np.array([self.labels[a:b].max() for a, b in self.spans])


def ball_interval(center: np.ndarray, radius: np.ndarray, centers: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products of any points of two sets of balls, widened by what rounding may lose."""
    middle = center @ centers.T
    norm, norms = np.linalg.norm(center, axis=1)[:, None], np.linalg.norm(centers, axis=1)[None, :]
    radius, radii = radius[:, None], radii[None, :]
    reach = radius * norms + radii * norm + radius * radii + 1e-6 * (1 + (norm + radius) * (norms + radii))
    return middle - reach, middle + reach


def node_intervals(a: Tree, b: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products of each pair of nodes: the narrowest that balls, boxes and norms give."""
    low, high = ball_interval(a.center, a.radius, b.center, b.radius)
    corners = [x[:, None, :] * y[None, :, :] for x in (a.low, a.high) for y in (b.low, b.high)]
    most = a.norm[:, None] * b.norm[None, :] * (1 + 1e-9) + 1e-6
    low = np.maximum(np.maximum(low, np.minimum.reduce(corners).sum(axis=2) - 1e-6), -most)
    return low, np.minimum(np.minimum(high, np.maximum.reduce(corners).sum(axis=2) + 1e-6), most)


def scores_of(a: Tree, b: Tree, rows: slice, columns: slice) -> np.ndarray:
    """Exact inner products of rows with rows."""
    x, y = a.points[rows], b.points[columns]
    if a.norm[0] * b.norm[0] < EXACT:
        return np.rint(x @ y.T).astype(np.int64)
    return a.whole[rows].astype(np.int64) @ b.whole[columns].astype(np.int64).T


def search(a: Tree, b: Tree, caps: np.ndarray, needs: np.ndarray, same: bool, k: int) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """The best ``k`` (score, complement of the id) of ``b`` for each (anchor, slot) of ``a``, as far as they can matter.

    ``caps`` and ``needs``: the largest score that a slot takes and the smallest of use; a slot without any has a cap below its need.
    """
    needs = needs.copy()
    best: dict[tuple[int, int], list[tuple[int, int]]] = {}
    open_slots = caps >= needs
    row_cap = np.where(open_slots, caps, LOWEST).max(axis=1)
    row_need = np.where(open_slots, needs, HIGHEST).min(axis=1)
    low, high = node_intervals(a, b)
    heap = [(-high[0, 0], 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        (start, stop), (first, last) = a.spans[i], b.spans[j]
        if -bound < row_need[start:stop].min() or low[i, j] > row_cap[start:stop].max():
            continue
        apart = a.last_label[i] < b.first_label[j] or b.last_label[j] < a.first_label[i]
        alike = a.first_label[i] == a.last_label[i] == b.first_label[j] == b.last_label[j]
        if apart if same else alike:
            continue
        down, across = a.children[i], b.children[j]
        if down and (not across or stop - start > last - first):
            for c in down:
                heapq.heappush(heap, (-high[c, j], c, j))
        elif across:
            for c in across:
                heapq.heappush(heap, (-high[i, c], i, c))
        else:
            scores = scores_of(a, b, slice(start, stop), slice(first, last))
            fits = (a.labels[start:stop, None] == b.labels[None, first:last]) == same
            fits &= (scores >= row_need[start:stop, None]) & (scores <= row_cap[start:stop, None])
            for r in np.flatnonzero(fits.any(axis=1)):
                at = start + int(r)
                columns = np.flatnonzero(fits[r])
                values, ties = scores[r, columns], ~b.ids[first + columns]
                for slot in np.flatnonzero(open_slots[at]):
                    use = np.flatnonzero((values >= needs[at, slot]) & (values <= caps[at, slot]))
                    if not len(use):
                        continue
                    if len(use) > k:
                        use = use[np.lexsort((ties[use], values[use]))[-k:]]
                    kept = best.get((at, int(slot)), []) + list(zip(values[use].tolist(), ties[use].tolist(), strict=True))
                    best[at, int(slot)] = kept = sorted(kept, reverse=True)[:k]
                    if len(kept) == k:
                        needs[at, slot] = max(needs[at, slot], kept[-1][0])
                row_need[at] = needs[at][open_slots[at]].min()
    return best


def whole_vectors(column: pa.Array, scale: int, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a vector that takes part, and those vectors as integers, filled up with zeros."""
    counts = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, dtype=np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    counts = np.where(column.is_valid().to_numpy(zero_copy_only=False), counts, 0)
    out = np.full((len(column), dimensions), 0.0)
    out[np.arange(dimensions)[None, :] < counts[:, None]] = values
    with np.errstate(all="ignore"):
        out = np.floor(scale * out)
        fine = (np.abs(out) <= LARGEST).all(axis=1) & column.is_valid().to_numpy(zero_copy_only=False)
    return fine, out[fine].astype("<i4")


def deal_rows(rows: DataFrame, cuts: Cuts, parts: np.ndarray, scale: int, dimensions: int) -> DataFrame:
    """Rows (``id``, ``label``, ``vector``) with integer vectors, each in a cell and a part of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            fine, whole = whole_vectors(batch.column(2), scale, dimensions)
            cells = cuts.cells(whole.astype(np.float64))
            part = ((seen + np.arange(len(cells))) % parts[cells]).astype(np.int32)
            seen += len(cells)
            kept = pa.array(np.flatnonzero(fine))
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(part), batch.column(1).take(kept), batch.column(0).take(kept), pa.array([v.tobytes() for v in whole], pa.binary())], names=[c.split()[0] for c in ROWS.split(", ")])

    return rows.mapInArrow(run, ROWS)


def pack(rows: DataFrame, cuts: Cuts, most: int, leaf: int) -> DataFrame:
    """Dealt rows as packs of at most ``most`` rows of a part, in the order of their tree. The ball is about the cell's own centre."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        held: list[tuple] = []
        place = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (place != row[:2] or len(held) == most):
                    yield packed(place, held, number)
                    held, number = [], number + 1
                place = row[:2]
                held.append(row[2:])
        if held:
            yield packed(place, held, number)

    def packed(place: tuple[int, int], held: list[tuple], number: int) -> pa.RecordBatch:
        from pyspark import TaskContext

        labels, ids, vectors = zip(*held, strict=True)
        whole = np.frombuffer(b"".join(vectors), "<i4").reshape(len(held), -1)
        labels, ids = np.array(labels, "<i8"), np.array(ids, "<i8")
        order = tree_order(whole.astype(np.float64), labels, leaf)
        width = 2 if np.abs(whole).max(initial=0) < 1 << 15 else 4
        center = cuts.centers[place[0]]
        radius = float(np.sqrt(((whole - center) ** 2).sum(axis=1).max(initial=0)))
        values = (*place, (TaskContext.get().partitionId() << 32) + number, len(held), width, ids[order].tobytes(), labels[order].tobytes(), whole[order].astype(f"<i{width}").tobytes(), center.tobytes(), radius)
        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
        fields = [f.split() for f in PACKED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], kinds[kind]) for v, (_, kind) in zip(values, fields, strict=True)], names=[n for n, _ in fields])

    return rows.repartition(parts, "cell", "part").sortWithinPartitions("cell", "part", "label").mapInArrow(run, PACKED)


def slots_of(n: int, state: list | None, n_slots: int, open_range: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Caps and needs of a group's anchors from (at, slot, cap, need) entries; slots without an entry have ``open_range``."""
    needs, caps = (np.full((n, n_slots), v, dtype=np.int64) for v in open_range)
    for at, slot, cap, need in state or []:
        caps[at, slot], needs[at, slot] = cap, need
    return caps, needs


def visits(groups: DataFrame, cells: dict[int, tuple[int, float]], centers: np.ndarray, own: bool, n_slots: int, open_range: tuple[int, int]) -> DataFrame:
    """Groups with the (cell, part) keys they have to meet: those of their own cell, or all others that can matter."""
    known = sorted(cells)
    radii = np.array([cells[c][1] for c in known])
    middles = centers[known] if known else centers[:0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, n, center, radius = (batch.column(c).to_pylist() for c in ("cell", "n", "center", "radius"))
            state = [[tuple(e.values()) for e in s or []] for s in batch.column("state").to_pylist()]
            for i in range(batch.num_rows):
                if own:
                    chosen = [c for c in known if c == cell[i]]
                else:
                    caps, needs = slots_of(n[i], state[i], n_slots, open_range)
                    usable = caps >= needs
                    if not usable.any():
                        continue
                    low, high = ball_interval(np.frombuffer(center[i])[None, :], np.array([radius[i]]), middles, radii)
                    meets = (high[0] >= needs[usable].min()) & (low[0] <= caps[usable].max())
                    chosen = [c for c, m in zip(known, meets, strict=True) if m and c != cell[i]]
                keys = [(c, p) for c in chosen for p in range(cells[c][0])]
                for k in range(0, len(keys), 16):
                    some = keys[k : k + 16]
                    taken = batch.take(pa.array([i] * len(some)))
                    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in some], pa.int32()), pa.array([p for _, p in some], pa.int32()), *(taken.column(c) for c in SENT)], names=["to_cell", "to_part", *SENT])

    kinds = dict(f.split() for f in PACKED.split(", "))
    schema = "to_cell int, to_part int, " + ", ".join(f"{c} {kinds[c]}" for c in SENT[:-1]) + f", state {STATE}"
    return groups.mapInArrow(run, schema)


SENT = ("number", "n", "width", "ids", "labels", "vectors", "state")
STATE = "array<struct<at:int,slot:int,cap:long,need:long>>"


def meet(sent: DataFrame, chunks: DataFrame, same: bool, k: int, n_slots: int, open_range: tuple[int, int]) -> DataFrame:
    """Search every group in the chunks it was sent to."""
    parts = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    there = chunks.select("cell", "part", *(F.col(c).alias(f"chunk_{c}") for c in ("number", *SENT[1:-1])))
    there, sent = there.repartition(parts, "cell", "part"), sent.repartition(parts, "to_cell", "to_part")
    pairs = sent.join(grown(there), (F.col("to_cell") == F.col("cell")) & (F.col("to_part") == F.col("part"))).drop("part", "to_cell", "to_part")
    names = [f.split()[0] for f in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[tuple, Tree] = {}

        def tree(kind: str, number: int, leaf: int, *fields) -> Tree:
            if (kind, number) not in trees:
                if len(trees) >= 32:
                    trees.pop(next(iter(trees)))
                trees[kind, number] = Tree(*fields, leaf)
            return trees[kind, number]

        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            for i in range(batch.num_rows):
                a = tree("group", columns["number"][i], ANCHOR_LEAF, *(columns[c][i] for c in SENT[1:-1]))
                b = tree("chunk", columns["chunk_number"][i], LEAF, *(columns[f"chunk_{c}"][i] for c in SENT[1:-1]))
                state = [tuple(e.values()) for e in columns["state"][i] or []]
                found = search(a, b, *slots_of(columns["n"][i], state, n_slots, open_range), same, k)
                if not found:
                    continue
                rows = [(columns["number"][i], at, slot, columns["cell"][i], int(a.ids[at]), int((a.whole[at].astype(np.int64) ** 2).sum()), [{"score": s, "tie": t} for s, t in best]) for (at, slot), best in found.items()]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.struct([("score", pa.int64()), ("tie", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    found = pairs.mapInArrow(run, FOUND)
    return merged(merged(found, k, "cell"), k)


def merged(found: DataFrame, k: int, *by: str) -> DataFrame:
    """The best ``k`` of each anchor and slot, in a cell or over all."""
    best = F.slice(F.sort_array(F.flatten(F.collect_list("best")), False), 1, k)
    return found.groupBy("number", "at", "slot", "anchor_id", "own", *by).agg(best.alias("best"))


def two_rounds(groups: DataFrame, chunks: DataFrame, cells: dict, centers: np.ndarray, same: bool, k: int, n_slots: int, state: DataFrame | None, open_range: tuple[int, int]) -> DataFrame:
    """The best ``k`` rows of every anchor and slot over all chunks. ``state``: (number, at, slot, cap, need) rows of slots."""

    def with_state(entries: DataFrame | None) -> DataFrame:
        if entries is None:
            return groups.withColumn("state", F.lit(None).cast(STATE))
        lists = entries.groupBy("number").agg(F.collect_list(F.struct("at", "slot", "cap", "need")).alias("state"))
        return groups.join(grown(lists), "number", "left")

    def search_cells(entries: DataFrame | None, own: bool) -> DataFrame:
        return meet(visits(with_state(entries), cells, centers, own, n_slots, open_range), chunks, same, k, n_slots, open_range)

    first = materialise(search_cells(state, True), "near")
    enough = first.where(F.size("best") == k).select("number", "at", "slot", F.col("best")[k - 1]["score"].alias("reached"))
    if state is None:
        known = enough.select("number", "at", "slot", F.lit(open_range[1]).alias("cap"), F.col("reached").alias("need"))
    else:
        known = state.join(grown(enough), ["number", "at", "slot"], "left")
        known = known.select("number", "at", "slot", "cap", F.coalesce(F.greatest("need", "reached"), "need").alias("need"))
    both = first.unionByName(search_cells(known, False))
    out = materialise(merged(both, k), "best")
    discard(first)
    return out


def hard_negatives(
    rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 5, low_percent: int = 80, high_percent: int = 100, scale: int = 256, cell_rows: int = CHUNK, chunk_rows: int = CHUNK, group_rows: int = GROUP
) -> DataFrame:
    """Hard negatives of the anchors among ``rows`` (``id`` long, ``label`` long, ``vector`` array of numbers).

    An anchor's positives are its best other rows of the same label, a positive's negatives the best rows of other labels with
    ``low_percent * positive_score <= 100 * score <= high_percent * positive_score``. Higher scores come first, then smaller ids.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").select(F.col("id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<double>"))
    n, dimensions = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    if dimensions > MOST_DIMENSIONS:
        raise ValueError(f"vectors have up to {dimensions} components, which is more than {MOST_DIMENSIONS}")
    dimensions = max(1, dimensions)
    most = min(SAMPLE, SAMPLE_COMPONENTS // dimensions)
    share = min(1.0, 1.5 * most / max(1, n))
    chosen = rows.where(F.pmod(F.xxhash64("id", "vector"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(most)
    fine, sample = whole_vectors(pa.array([r[0] for r in chosen.select("vector").collect()], pa.list_(pa.float64())), scale, dimensions)
    cuts = Cuts(sample.astype(np.float64), min(MOST_CELLS, max(1, n // cell_rows)))
    shares = np.bincount(cuts.cells(sample.astype(np.float64)), minlength=len(cuts.centers)) / max(1, len(sample))
    parts = np.maximum(1, np.ceil(shares * n / chunk_rows)).astype(np.int64)
    chunks = materialise(pack(deal_rows(rows, cuts, parts, scale, dimensions), cuts, chunk_rows, LEAF), "chunks")
    groups = materialise(pack(deal_rows(rows.where(is_anchor), cuts, np.ones_like(parts), scale, dimensions), cuts, group_rows, ANCHOR_LEAF), "groups")
    cells = {r.cell: (int(parts[r.cell]), r.radius) for r in chunks.groupBy("cell").agg(F.max("radius").alias("radius")).collect()}
    # One more than wanted: the anchor is among its own rows.
    near = two_rounds(groups, chunks, cells, cuts.centers, True, n_positives + 1, 1, None, (LOWEST, HIGHEST))
    itself = F.array_position("best", F.struct(F.col("own").alias("score"), F.bitwise_not("anchor_id").alias("tie")))
    place = itself.cast("int")
    others = F.when(place > 0, F.concat(F.slice("best", F.lit(1), place - 1), F.slice("best", place + 1, F.lit(n_positives + 1)))).otherwise(F.slice("best", 1, n_positives))
    exploded = near.select("number", "at", "anchor_id", F.posexplode(others).alias("slot", "row"))
    positives = materialise(exploded.select("number", "at", "slot", "anchor_id", F.bitwise_not("row.tie").alias("positive_id"), F.col("row.score").alias("positive_score")), "positives")
    score = F.col("positive_score").cast("decimal(38,0)")
    # The smallest and largest whole scores within the percentages, rounded in decimals.
    lower, upper = F.ceil(score * low_percent / 100), F.floor(score * high_percent / 100)
    bounds = positives.select("number", "at", "slot", F.least(upper, F.lit(HIGHEST)).cast("long").alias("cap"), F.greatest(lower, F.lit(LOWEST)).cast("long").alias("need"))
    found = two_rounds(groups, chunks, cells, cuts.centers, False, n_negatives, n_positives, bounds, (0, -1))
    lists = found.select("number", "at", "slot", "best")
    joined = positives.join(grown(lists), ["number", "at", "slot"]).select("anchor_id", "positive_id", "positive_score", (F.col("slot") + 1).alias("positive_rank"), F.posexplode("best").alias("place", "row"))
    out = joined.select("anchor_id", "positive_id", (F.col("place") + 1).cast("int").alias("rank"), F.bitwise_not("row.tie").alias("negative_id"), "positive_score", F.col("row.score").alias("negative_score"), "positive_rank")
    discard(near, chunks, groups)
    return out


def op11_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector of ``embeddings``, with a seventh of the labels moved."""
    label = F.col("label").cast("long")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives(rows, F.col("id") % 100 == 0)
