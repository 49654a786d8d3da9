"""Cohort aggregates. Ties fall as the input's order column says, never as rows happen to arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodspark.functions.text import split_tags
from moodspark.sources.files import checkpointed, kept


def dedupe_canonical(entries: DataFrame, order: Sequence[str], title: str = "title", artist: str = "artist", rank: str = "rank", weeks: str = "weeks", date: str = "chart_date") -> DataFrame:
    """One row per artist and title, case and outer spaces aside: the first non-null spellings in order, best rank, most weeks, first date."""
    place = F.struct(*order)
    key = F.concat(F.lower(F.trim(artist)), F.lit("||"), F.lower(F.trim(title)))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c)
    return entries.groupBy(key.alias("canonical_key")).agg(first(title), first(artist), F.min(rank).alias("chart_rank"), F.max(weeks).alias("chart_weeks_on"), F.min(date).alias("first_chart_date"))


def cohort_counts(df: DataFrame, cohort: str, *counted: str) -> DataFrame:
    """Rows and non-null values of each cohort."""
    return df.groupBy(cohort).agg(F.count("*").alias("row_count"), *(F.count(c).alias(f"{c}_count") for c in counted))


def cohort_mean(df: DataFrame, cohort: str, value: str) -> DataFrame:
    return df.groupBy(cohort).agg(F.avg(value).alias("mean_value"))


def mode_value(column: str | Column) -> Column:
    """The most frequent value, the smallest of several, null for none."""
    return F.mode(F.col(column) if isinstance(column, str) else column, deterministic=True)


def mode_excluding(column: str, label: str) -> Column:
    return mode_value(F.when(~F.col(column).eqNullSafe(label), F.col(column)))


def top_tags(df: DataFrame, cohort: str, tags: str, order: Sequence[str], n: int = 5) -> DataFrame:
    """The ``n`` most frequent tags of each cohort joined by '|'; ties as first met."""
    place = F.struct(*order)
    exploded = df.select(F.col(cohort), place.alias("__place"), F.posexplode(split_tags(tags)).alias("__pos", "tag"))
    counted = exploded.groupBy(cohort, "tag").agg(F.count("*").alias("n"), F.min(F.struct("__place", "__pos")).alias("first"))
    window = Window.partitionBy(cohort).orderBy(F.col("n").desc(), F.col("first"))
    return _joined(counted.withColumn("r", F.row_number().over(window)).where(F.col("r") <= n), cohort, "tag", "top_tags")


def top_titles(df: DataFrame, cohort: str, title: str, score: str, order: Sequence[str], n: int = 3) -> DataFrame:
    """The titles of the ``n`` highest scores of each cohort joined by '|'; rows without a score don't count, ties as first met."""
    window = Window.partitionBy(cohort).orderBy(F.col(score).desc(), *order)
    named = F.coalesce(F.col(title), F.lit("nan")).alias("title")
    ranked = df.where(F.col(score).isNotNull()).select(cohort, named, F.row_number().over(window).alias("r")).where(F.col("r") <= n)
    return _joined(ranked, cohort, "title", "top_titles")


def _joined(ranked: DataFrame, cohort: str, column: str, out: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("r", column)))
    return ranked.groupBy(cohort).agg(F.array_join(F.transform(listed, lambda s: s[column]), "|").alias(out))


def nonnull_fraction(column: str) -> Column:
    return F.avg(F.col(column).isNotNull().cast("double"))


def coverage_rate(quality: str, score: str, full: str = "full") -> Column:
    """The share of full-quality rows that have a score; 1 where there are none."""
    whole = F.col(quality) == full
    return F.coalesce(F.count_if(whole & F.col(score).isNotNull()) / F.nullif(F.count_if(whole), F.lit(0)), F.lit(1.0))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def label_share(df: DataFrame, cohort: str, label: str, valid: Sequence[str]) -> DataFrame:
    """Counts of valid labels by cohort and their share of the cohort's valid labels in percent."""
    counted = df.where(F.col(label).isin(list(valid))).groupBy(cohort, label).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(cohort))
    return counted.withColumn("pct", F.rint(F.col("n") / total * 1000) / 10)


def tag_penetration(df: DataFrame, cohort: str, tags: str) -> DataFrame:
    """Per cohort and tag the share of the cohort's rows in percent; a tag that a row names twice counts twice."""
    sizes = df.groupBy(cohort).agg(F.count("*").alias("rows"))
    tagged = df.select(cohort, F.explode(split_tags(tags)).alias("tag")).groupBy(cohort, "tag").agg(F.count("*").alias("n"))
    return tagged.join(sizes, cohort).select(cohort, "tag", (F.col("n") / F.col("rows") * 100).alias("pct"))


def tag_penetration_pivot(df: DataFrame, cohort: str, tags: str, cohorts: Sequence[str]) -> DataFrame:
    """``tag_penetration`` with a column for each cohort, 0 where a tag is missing."""
    return tag_penetration(df, cohort, tags).groupBy("tag").pivot(cohort, list(cohorts)).agg(F.first("pct")).na.fill(0.0)


def distribution_summary(df: DataFrame, cohort: str, value: str) -> DataFrame:
    """The exact five-number summary of each cohort (linear between neighbours) and the fences beyond which values are outliers.

    Values are counted first; the distinct ones are dealt out by ranges of cohort and value and written, and how many
    rows of a cohort stand before a range is added up over ranges. So no task sorts more than a range.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(cohort, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    ranged = checkpointed(counted.repartitionByRange(F.col(cohort), F.col("v")).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy("__range", cohort).agg(F.sum("n").alias("__n"))
    part = Window.partitionBy(cohort)
    earlier = part.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("__range").alias("__of"), F.col(cohort).alias("__cohort"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"), F.sum("__n").over(part).alias("total"))
    within = Window.partitionBy("__range", cohort).orderBy("v")
    placed = ranged.withColumn("upto", F.sum("n").over(within))
    met = placed.join(before, (F.col("__range") == F.col("__of")) & F.col(cohort).eqNullSafe(F.col("__cohort")))
    ranked = met.select(cohort, "v", "n", (F.col("upto") + F.col("__before")).alias("upto"), "total")
    names = ("low", "q1", "median", "q3", "high")
    edges = []
    for name, share in zip(names, (0.0, 0.25, 0.5, 0.75, 1.0), strict=True):
        place = share * (F.col("total") - 1)
        edges += [F.min(F.when(F.col("upto") > F.floor(place), F.col("v"))).alias(f"{name}_a"), F.min(F.when(F.col("upto") > F.ceil(place), F.col("v"))).alias(f"{name}_b")]
        edges.append(F.first(place - F.floor(place)).alias(f"{name}_w"))
    met = ranked.groupBy(cohort).agg(*edges)
    five = met.select(cohort, *((F.col(f"{n}_a") + (F.col(f"{n}_b") - F.col(f"{n}_a")) * F.col(f"{n}_w")).alias(n) for n in names))
    spread = F.col("q3") - F.col("q1")
    return five.withColumns({"lower_fence": F.col("q1") - 1.5 * spread, "upper_fence": F.col("q3") + 1.5 * spread})


#: The sketch's ranks are off by one in so many at most, and cohorts that are broadcast at most.
RANKS, MOST_COHORTS = 10_000, 10_000


def beside(rows: DataFrame, facts: DataFrame, cohort: str) -> DataFrame:
    """Rows with the facts of their cohort, which are written and have a row a cohort."""
    few = facts.count() <= MOST_COHORTS
    named = facts.withColumnRenamed(cohort, "__of")
    return rows.join(F.broadcast(named) if few else named, F.col(cohort).eqNullSafe(F.col("__of"))).drop("__of")


def exact_quartiles(df: DataFrame, cohort: str, value: str) -> DataFrame:
    """Cohort, ``n``, ``q1`` and ``q3`` (linear between neighbours), exact and without sorting or writing the values.

    A mergeable sketch with a proven bound on its error gives, for each rank that is wanted, two values that it must lie
    between. A second pass counts the values below and those between, by value; the rank is picked among the latter,
    one in ``RANKS / 4`` of a cohort's rows and fewer distinct values. Nulls and not-a-numbers don't count.
    """
    rows = df.select(F.col(cohort).alias("__cohort"), F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    shares = [(name, max(0.0, p - 2 / RANKS), min(1.0, p + 2 / RANKS)) for name, p in (("q1", 0.25), ("q3", 0.75))]
    sketch = F.percentile_approx("__v", [x for _, a, b in shares for x in (a, b)], RANKS)
    brackets = kept(rows.groupBy("__cohort").agg(F.count("*").alias("n"), F.min("__v").alias("__least"), F.max("__v").alias("__most"), sketch.alias("__at")), "brackets")
    sides = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(p).alias("p"), F.col("__at")[2 * i].alias("a"), F.col("__at")[2 * i + 1].alias("b")) for i, (name, p) in enumerate((("q1", 0.25), ("q3", 0.75)))))
    # A cohort so small that a bracket may miss a neighbour is taken whole.
    small = F.col("n") <= 10 * RANKS
    met = beside(rows, brackets.withColumn("__sides", F.transform(sides, lambda s: F.struct(s["name"].alias("name"), s["p"].alias("p"), F.when(small, F.col("__least")).otherwise(s["a"]).alias("a"), F.when(small, F.col("__most")).otherwise(s["b"]).alias("b")))).select("__cohort", "n", "__sides"), "__cohort")
    sided = met.select("__cohort", "n", "__v", F.explode("__sides").alias("s")).where("__v <= s.b")
    # What lies below a bracket is one row for it.
    counted = sided.groupBy("__cohort", "n", F.col("s.name").alias("name"), F.col("s.p").alias("p"), F.when(F.col("__v") >= F.col("s.a"), F.col("__v")).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("__cohort", "name").orderBy(F.col("v").asc_nulls_first()))
    place = F.col("p") * (F.col("n") - 1)
    ranked = counted.withColumns({"upto": upto, "place": place})
    ends = ranked.groupBy("__cohort", "n", "name").agg(F.min(F.when(F.col("upto") > F.floor("place"), F.col("v"))).alias("x"), F.min(F.when(F.col("upto") > F.ceil("place"), F.col("v"))).alias("y"), F.first(F.col("place") - F.floor("place")).alias("w"))
    exact = ends.withColumn("q", F.col("x") + (F.col("y") - F.col("x")) * F.col("w"))
    made = exact.groupBy(F.col("__cohort").alias(cohort), "n").agg(*(F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in ("q1", "q3")))
    return kept(made, "quartiles")


def distribution_outliers(df: DataFrame, cohort: str, value: str, reach: float = 1.5) -> DataFrame:
    """The rows whose value is beyond its cohort's fences, with ``side`` and the ends of both whiskers: the outermost values within."""
    spread = F.col("q3") - F.col("q1")
    fences = exact_quartiles(df, cohort, value).select(cohort, (F.col("q1") - reach * spread).alias("lower_fence"), (F.col("q3") + reach * spread).alias("upper_fence"))
    fenced = beside(df, fences, cohort)
    v = F.col(value).cast("double")
    within = fenced.where(v.between(F.col("lower_fence"), F.col("upper_fence"))).groupBy(cohort).agg(F.min(v).alias("whisker_low"), F.max(v).alias("whisker_high"))
    out = fenced.where(((v < F.col("lower_fence")) | (v > F.col("upper_fence"))) & ~F.isnan(v)).withColumn("side", F.when(v < F.col("lower_fence"), "low").otherwise("high"))
    return beside(out.drop("lower_fence", "upper_fence"), kept(within, "whiskers"), cohort)


def extreme_cohort(df: DataFrame, cohort: str, value: str, order: str, largest: bool = True) -> DataFrame:
    """The cohort with the largest (smallest) value; nulls don't count, the first in order wins."""
    known = df.where(F.col(value).isNotNull())
    pick = F.max_by(cohort, F.struct(F.col(value), -F.col(order))) if largest else F.min_by(cohort, F.struct(F.col(value), F.col(order)))
    return known.agg(pick.alias(cohort))


def label_distribution(df: DataFrame, label: str, n: int = 6) -> DataFrame:
    """The ``n`` most frequent labels and their share of all rows in percent."""
    total = df.agg(F.count("*").alias("total"))
    counted = value_counts(df, label).orderBy(F.col("n").desc(), label).limit(n)
    # One row: the total of all rows.
    return counted.join(F.broadcast(total)).select(label, "n", (F.col("n") / F.col("total") * 100).alias("pct"))


def conditional_counts(conditions: dict[str, Column]) -> list[Column]:
    return [F.count_if(c).alias(name) for name, c in conditions.items()]
