"""Document fingerprints: one-permutation MinHash with optimal densification.

Every five-word shingle is hashed once; the hash's high bits name one of ``BINS``
bins, each bin keeps its smallest value. An empty bin borrows from the first full
one of its own pseudo-random sequence of bins (Shrivastava, "Optimal densification
for fast and accurate minwise hashing", 2017). Of each value the low ``BITS`` bits
are packed; the likeness corrects for bits that agree by chance (Li and König,
"b-bit minwise hashing", 2010). All of it is Spark SQL expressions.

Words are separated by white space; a text of fewer words than a shingle is one
shingle; a text without words has an empty fingerprint, which is like another
empty one and unlike all others. Null texts are empty texts. Of rows that repeat
an id the one with the shortest text counts (the smallest hash of several). Rows without an id are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moodspark.llm.common import materialise, table

BINS, BITS, SHINGLE = 256, 4, 5
#: Positions below the bin number in a non-negative 63-bit value.
LOW = 63 - (BINS.bit_length() - 1)
#: Bins that are tried in turn for an empty bin before the exhaustive fallback.
TRIES = 12
PER_LONG = 64 // BITS


def words(text: Column) -> Column:
    """The words of a text; none has an empty array."""
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def shingle_hashes(tokens: Column, size: int = SHINGLE) -> Column:
    """One 63-bit odd hash a shingle."""
    odd = lambda h: F.shiftrightunsigned(h, 1).bitwiseOR(F.lit(1))
    runs = F.transform(
        F.sequence(F.lit(0), F.size(tokens) - size),
        lambda i: odd(F.xxhash64(*(F.get(tokens, i + k) for k in range(size)))),
    )
    return (
        F.when(F.size(tokens) == 0, F.array().cast("array<bigint>"))
        .when(F.size(tokens) < size, F.array(odd(F.xxhash64(F.array_join(tokens, " ")))))
        .otherwise(runs)
    )


def sorted_with_sentinels(hashes: Column) -> Column:
    """The hashes in order, with an even sentinel behind those of each bin.

    A bin's sentinel is its largest even value, so it leads its bin only if that is empty
    (a hash above its sentinel is the sentinel + 1 alone: once in 2^54 shingles, then the bin counts as empty).
    """
    return F.sort_array(F.concat(hashes, F.array(*(F.lit(((b + 1) << LOW) - 2) for b in range(BINS)))))


def bin_minima(ordered: str) -> Column:
    """The smallest value of each bin, in order of bins; ``ordered`` names the sorted column."""
    bin_of = lambda v: F.shiftright(v, LOW)
    return F.filter(ordered, lambda v, i: (i == 0) | (bin_of(F.get(F.col(ordered), i - 1)) != bin_of(v)))


def donors() -> list[list[int]]:
    """``TRIES`` pseudo-random bins for each bin, from a multiplicative hash."""
    mixed = lambda b, t: ((b * 2654435761 + t * 40503 + 977) * 2246822519 >> 15) % BINS
    return [[mixed(b, t) for b in range(BINS)] for t in range(1, TRIES + 1)]


def densify(minima: Column) -> Column:
    """Fill empty bins; the result is in bin order. All bins empty: unchanged."""
    full = lambda v: F.when(v.bitwiseAND(F.lit(1)) == 1, v)
    tables = [F.array(*map(F.lit, row)) for row in donors()]
    step = 101  # odd, so the walk meets every bin

    def fill(value: Column, place: Column) -> Column:
        tried = [full(F.get(minima, F.get(row, place))) for row in tables]
        walk = F.filter(F.transform(F.sequence(F.lit(1), F.lit(BINS - 1)), lambda k: F.get(minima, F.pmod(place + k * step, F.lit(BINS)))), lambda v: v.bitwiseAND(F.lit(1)) == 1)
        return F.coalesce(full(value), *tried, F.get(walk, F.lit(0)), value)

    return F.transform(minima, fill)


def pack(dense: Column) -> Column:
    """The low bits above the lowest one of each value, ``PER_LONG`` to a 64-bit integer."""
    low = lambda v: F.shiftright(v, 1).bitwiseAND(F.lit((1 << BITS) - 1))
    word = lambda j: F.aggregate(F.slice(dense, j * PER_LONG + 1, PER_LONG), F.lit(0).cast("bigint"), lambda acc, v: F.shiftleft(acc, BITS).bitwiseOR(low(v)))
    # Spelled out: named once inside a lambda, the optimizer would compute the column anew for every element.
    return F.array(*map(word, range(BINS // PER_LONG)))


def add_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the packed fingerprint (array of 64-bit integers, empty for a text without words)."""
    steps = [
        ("__tokens", words(F.coalesce(F.col(text), F.lit("")))),
        ("__hashes", shingle_hashes(F.col("__tokens"))),
        ("__sorted", sorted_with_sentinels(F.col("__hashes"))),
        ("__minima", bin_minima("__sorted")),
        ("__dense", densify(F.col("__minima"))),
    ]
    for name, made in steps:  # a column each: an expression inside a lambda would be computed for every element
        df = df.withColumn(name, made)
    packed = F.when(F.size("__hashes") == 0, F.array().cast("array<bigint>")).otherwise(pack(F.col("__dense")))
    return df.withColumn(out, packed).drop(*(name for name, _ in steps))


def hexed(fingerprint: str | Column) -> Column:
    """A packed fingerprint as lower-case hexadecimal text."""
    return F.array_join(F.transform(fingerprint, lambda v: F.lower(F.lpad(F.hex(v), 16, "0"))), "")


def likeness(a: str, b: str) -> Column:
    """The share of agreeing bins, corrected for chance, 0 to 1."""
    lowest = sum(1 << (BITS * i) for i in range(PER_LONG))
    lowest -= (1 << 64) if lowest >= 1 << 63 else 0

    def differing(x: Column, y: Column) -> Column:
        bits = x.bitwiseXOR(y)
        for k in (1, 2):
            bits = bits.bitwiseOR(F.shiftrightunsigned(bits, k))
        return F.bit_count(bits.bitwiseAND(F.lit(lowest)))

    unequal = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda acc, v: acc + v.cast("int"))
    chance = 1 / (1 << BITS)
    corrected = ((1 - unequal / BINS) - chance) / (1 - chance)
    either_empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(either_empty, F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), corrected))


def successors(ids: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, next_id) by ascending id, the last followed by the first.

    The ids are dealt out by range and written, so that each range is ordered by itself;
    only the first id of each range meets in one task.
    """
    dealt = ids.select(doc_id).repartitionByRange(F.col(doc_id)).withColumn("__part", F.spark_partition_id())
    dealt = materialise(dealt, "ids")
    firsts = dealt.groupBy("__part").agg(F.min(doc_id).alias("__first"))
    firsts = firsts.select("__part", F.lead("__first").over(Window.orderBy("__part")).alias("__after"))
    smallest = dealt.agg(F.min(doc_id).alias("__smallest"))
    inner = dealt.withColumn("next_id", F.lead(doc_id).over(Window.partitionBy("__part").orderBy(doc_id)))
    joined = inner.join(F.broadcast(firsts), "__part", "left").join(F.broadcast(smallest))
    return joined.select(doc_id, F.coalesce("next_id", "__after", "__smallest").alias("next_id"))


def op3_one_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint every whole text of ``documents`` and its edited text.

    The edited text ends with the beginning of the next document's text. Only that
    beginning travels to the edited row, beside one shuffle of the whole texts by id.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.col("doc_id").isNotNull())
    order = F.struct(F.length("text"), F.xxhash64("text"))
    # One row an id before anything meets it: repeated rows go in the partial aggregation, ahead of the shuffle.
    texts = docs.groupBy("doc_id").agg(F.min_by("text", order).alias("text"))
    heads = materialise(docs.groupBy("doc_id").agg(F.min(F.length("text")).alias("n")), "heads")
    links = materialise(successors(heads).join(heads, "doc_id").select("doc_id", "next_id", F.floor(F.col("n") / 4).cast("int").alias("take")), "links")
    wanted = links.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("__to"), "take")
    patches = texts.join(wanted, "doc_id").select(F.col("__to").alias("doc_id"), F.expr("left(text, take)").alias("__patch"))
    edited = (
        texts.join(patches, "doc_id")
        .select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), "__patch")
        .withColumn("__edited", F.concat(F.expr("left(text, n_chars - floor(n_chars / 4))"), F.col("__patch")))
    )
    printed = add_fingerprint(add_fingerprint(edited, "text", "own"), "__edited", "changed")
    rows = materialise(printed.select("doc_id", "n_chars", F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"), "own", "changed"), "prints")
    after = rows.select(F.col("doc_id").alias("next_id"), F.col("own").alias("following"))
    return (
        rows.join(links.select("doc_id", "next_id"), "doc_id")
        .join(after, "next_id")
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            hexed("own").alias("fingerprint"),
            hexed("changed").alias("edited_fingerprint"),
            likeness("own", "changed").alias("near_edited"),
            likeness("own", "following").alias("near_next"),
        )
    )
