"""A Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups, proofs and their check.

``write_manifest`` keeps the node store as level-partitioned Parquet in a folder:

* ``runs``: leaves sorted by group, key and leaf in runs, as Spark's range partitions are. No task holds more than
  a run, so a group with a third of all rows spans many. A leaf's place in its group is its place in the run and what
  the runs before it hold of the group, a sum over a row for each run and group.
* ``groups/level=k`` and ``top/level=k``: the nodes of level k with their tree, place and the width of their level.
  A level is one scan of the files of the level before it: runs of ``ARITY`` places are gathered by partial
  aggregation, so a group of nodes that stands in one file crosses the shuffle as one row. Files are sorted by coordinate.

``extract_proofs`` goes down again: at each level the runs of nodes are merge-joined by (tree, place) with what lies
above them, so every level is read once and a proof is never put together from lookups. What is joined shrinks
sixteenfold a level; the widest join has a row for sixteen leaves.

Digests are lower-case hexadecimal text. Groups may be null and count as a group, the first one. Keys may be null and
come first; rows that repeat a key are leaves of their own, in the order of their digests, and rows alike in all of it
are interchangeable leaves. Very long texts pass through one row's hash and are not written. Only the named columns of
a table are read, so extra ones can't clash; columns to carry must not have one of the names in ``OWN``. An empty table
has no root and no proofs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moodspark.llm.common import checked, discard, grown, materialise, scratch, table

ARITY = 16
#: Hexadecimal digits of a digest.
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
OWN = ("group", "key", "leaf", "run", "row", "tree", "place", "width", "digest", "path", "subroot", "root")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest_of(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """A value with its UTF-8 length before it, so that no two rows give the same bytes; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: dict[str, Column]) -> Column:
    """The digest of a row, its fields in the given order."""
    return digest_of(*(framed(value) for value in values.values()))


def sorted_runs(rows: DataFrame, keys: list[str], path: str) -> DataFrame:
    """The rows in runs, sorted over all of them; written, so that a run's number and a row's place in it stay."""
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # monotonically_increasing_id has the partition's number in the high bits and the row's place in the low 33.
    at = F.monotonically_increasing_id()
    ranged.withColumn("at", at).withColumns({"run": F.shiftright("at", 33), "row": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("at").write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def placed_groups(groups: DataFrame, path: str) -> DataFrame:
    """Number the groups in ascending order, null first, as trees."""
    runs = sorted_runs(groups, ["group"], path)
    earlier = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    before = runs.groupBy("run").agg(F.count("*").alias("n")).select("run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return runs.join(checked(before), "run").select("group", "width", (F.col("before") + F.col("row")).alias("tree"))


def raise_levels(spark: SparkSession, folder: str, widest: int) -> int:
    """Write the levels above ``level=0`` until every tree has one node; the height of the highest tree."""
    level = 0
    while widest > 1:
        below = spark.read.parquet(f"{folder}/level={level}").where("width > 1")
        parent = F.floor(F.col("place") / ARITY).alias("parent")
        runs = below.groupBy("tree", "width", parent).agg(F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("nodes"))
        node = digest_of(F.array_join(F.col("nodes.digest"), ""))
        above = runs.select("tree", F.col("parent").alias("place"), F.ceil(F.col("width") / ARITY).alias("width"), node.alias("digest"))
        widest, level = -(-widest // ARITY), level + 1
        above.sortWithinPartitions("tree", "place").write.parquet(f"{folder}/level={level}")
    return level


def write_manifest(leaves: DataFrame, folder: str) -> None:
    """Write the node store of ``leaves`` (``group``, ``key``, ``leaf`` and columns to carry) to ``folder``."""
    spark = leaves.sparkSession
    runs = sorted_runs(leaves, ["group", "key", "leaf"], f"{folder}/runs")
    sizes = materialise(runs.groupBy("run", "group").agg(F.count("*").alias("n"), F.min("row").alias("least")), "sizes")
    groups = placed_groups(sizes.groupBy("group").agg(F.sum("n").alias("width")), f"{folder}/group_runs")
    groups.write.parquet(f"{folder}/trees")
    trees = spark.read.parquet(f"{folder}/trees").withColumnRenamed("group", "of")
    earlier = Window.partitionBy("group").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.withColumn("shift", F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("least"))
    shifts = shifts.join(checked(trees), F.col("group").eqNullSafe(F.col("of")))
    shifts = materialise(shifts.select(F.col("run").alias("in_run"), "of", "shift", "tree", "width"), "shifts")
    same = (F.col("run") == F.col("in_run")) & F.col("group").eqNullSafe(F.col("of"))
    placed = runs.join(checked(shifts), same).withColumn("place", F.col("row") + F.col("shift")).drop("run", "row", "shift", "of", "in_run")
    placed.write.parquet(f"{folder}/leaves")
    discard(sizes, shifts)
    spark.read.parquet(f"{folder}/leaves").select("tree", "place", "width", F.col("leaf").alias("digest")).write.parquet(f"{folder}/groups/level=0")
    widest, n_trees = trees.agg(F.coalesce(F.max("width"), F.lit(0)), F.count("*")).first()
    height = raise_levels(spark, f"{folder}/groups", widest)
    subroots = nodes(spark, folder, "groups", height).where("width = 1")
    subroots.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(n_trees).cast("long").alias("width"), "digest").write.parquet(f"{folder}/top/level=0")
    raise_levels(spark, f"{folder}/top", n_trees)


def nodes(spark: SparkSession, folder: str, part: str, height: int) -> DataFrame:
    """All nodes of a part of the store up to a level."""
    return spark.read.option("basePath", f"{folder}/{part}").parquet(*(f"{folder}/{part}/level={k}" for k in range(height + 1)))


def heights(spark: SparkSession, folder: str) -> tuple[int, int]:
    """The heights of the highest tree of a group and of the tree over the groups."""
    widest, n_trees = spark.read.parquet(f"{folder}/trees").agg(F.coalesce(F.max("width"), F.lit(0)), F.count("*")).first()
    return levels_of(widest), levels_of(n_trees)


def levels_of(width: int) -> int:
    level = 0
    while width > 1:
        width, level = -(-width // ARITY), level + 1
    return level


def below(parents: DataFrame, level: DataFrame, carried: list[str], wanted: DataFrame | None = None) -> DataFrame:
    """The nodes of a level under ``parents``, each with its siblings before and after it at the head of its path."""
    rows = level.where("width > 1").withColumn("parent", F.floor(F.col("place") / ARITY))
    if wanted is not None:
        rows = rows.join(grown(wanted), ["tree", "parent"], "left_semi")
    runs = rows.groupBy("tree", "parent").agg(F.array_sort(F.collect_list(F.struct("place", "digest", "width", *carried))).alias("nodes"))
    joined = runs.join(grown(parents.select("tree", F.col("place").alias("parent"), "path", "subroot", "root")), ["tree", "parent"])
    each = joined.withColumn("all", F.array_join(F.col("nodes.digest"), "")).select("*", F.posexplode("nodes").alias("at", "node"))
    left = F.substring(F.col("all"), F.lit(1), F.col("at") * HEX)
    right = F.substring(F.col("all"), (F.col("at") + 1) * HEX + 1, F.lit(ARITY * HEX))
    path = F.array_prepend("path", F.struct(left.alias("left"), right.alias("right")))
    return each.select("tree", "node.*", path.alias("path"), "subroot", "root")


def extract_proofs(spark: SparkSession, folder: str, wanted: DataFrame | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """The leaves with their path to the root: siblings to the left and right of each level, the leaf's own level first.

    ``wanted`` (``group``, ``key``) restricts the scans to what the proofs of those leaves need.
    """
    height, top = heights(spark, folder)
    leaves = spark.read.parquet(f"{folder}/leaves").withColumnRenamed("leaf", "digest")
    coordinates: list[DataFrame | None] = [None] * (height + 1)
    if wanted is not None:
        asked = wanted.select(F.col("group").alias("of"), F.col("key").alias("at")).distinct()
        chosen = F.col("group").eqNullSafe(F.col("of")) & F.col("key").eqNullSafe(F.col("at"))
        found = materialise(leaves.join(grown(asked), chosen, "left_semi").select("tree", "place"), "coordinates")
        coordinates = [found.select("tree", F.floor(F.col("place") / ARITY ** (k + 1)).alias("parent")).distinct() for k in range(height + 1)]
    empty = F.array().cast("array<struct<left:string,right:string>>")
    level = spark.read.parquet(f"{folder}/top/level={top}")
    above = level.select("tree", "place", "digest", empty.alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    for k in reversed(range(top)):
        above = below(above, spark.read.parquet(f"{folder}/top/level={k}"), [])
    heads = above.select(F.col("place").alias("tree"), "digest", "path", F.col("digest").alias("subroot"), "root")
    kept = ["key", "group", *carried]
    above = None
    for k in reversed(range(height + 1)):
        level = leaves if k == 0 else spark.read.parquet(f"{folder}/groups/level={k}")
        more = kept if k == 0 else []
        # A tree of this height begins here, with what lies above its subroot.
        begun = level.where("width = 1").join(grown(heads.drop("digest")), "tree")
        columns = ["tree", "place", "digest", *more, "path", "subroot", "root"]
        made = begun.select(*columns)
        above = made if above is None else made.unionByName(below(above, level, more, coordinates[k]).select(*columns))
    if wanted is not None:
        above = above.join(grown(found), ["tree", "place"], "left_semi")
    return above.withColumnRenamed("digest", "leaf")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, level: digest_of(level["left"], node, level["right"]))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda level: F.concat(level["left"], level["right"])), ""), 256)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of ``documents`` by source; every leaf, some of them tampered with, held against the root by its proof."""
    docs = table(spark, sf_dir, "documents")
    values = {name: F.col(name) for name in FIELDS}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    claimed = F.when(tampered, leaf_of(values | {"text": F.translate("text", UPPER, LOWER)}))
    rows = materialise(docs.select(F.col("source").alias("group"), F.col("doc_id").alias("key"), leaf_of(values).alias("leaf"), claimed.alias("claimed")), "leaves")
    folder = scratch(spark, "manifest")
    write_manifest(rows, folder)
    proofs = extract_proofs(spark, folder, carried=("claimed",))
    root = folded(F.coalesce("claimed", "leaf"), F.col("path"))
    out = proofs.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
