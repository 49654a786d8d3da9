"""Connected components of an edge table by smallest labels, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodspark.llm.common import checked, discard, materialise


def hooked(edges: DataFrame) -> DataFrame:
    """(id, component): for every id of ``edges`` an id of its component that is no larger.

    Every id hooks to its smallest neighbour, if that is smaller, and then takes two jumps along these hooks.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hooks = materialise(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("component")), "hooks")
    parents = checked(hooks, hooks.select(F.col("id").alias("component"), F.col("component").alias("far")))
    labels = hooks
    for _ in range(2):
        labels = labels.join(parents, "component").select("id", F.col("far").alias("component"))
    made = materialise(labels, "labels")
    discard(hooks)
    return made


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over undirected ``edges`` (a, b), for every id in them.

    Each round gives every id the name of one that it is joined with and no larger, and keeps the edges between
    different names for the next. The smallest id of a component keeps its name, and when no edge is left all
    others have come to it. An id that is neither hooked nor hooked to has a smaller neighbour in the next round, so two
    rounds at least halve the ids that still have edges, in whatever order a chain's ids are:
    rounds grow with the logarithm and end by themselves. Every round is written to the shared
    folder. A node with very many edges meets a partial minimum first.
    """
    rounds, left = [hooked(edges)], []
    while True:
        a, b = (checked(rounds[-1], rounds[-1].select(F.col("id").alias(k), F.col("component").alias(f"root_{k}"))) for k in "ab")
        between = edges.join(a, "a").join(b, "b").where("root_a <> root_b")
        edges = materialise(between.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "edges")
        discard(*left)
        left = [edges]
        if edges.isEmpty():
            break
        rounds.append(hooked(edges))
    labels = rounds[0]
    for later in rounds[1:]:
        far = checked(later, later.select(F.col("id").alias("component"), F.col("component").alias("far")))
        labels = labels.join(far, "component", "left").select("id", F.coalesce("far", "component").alias("component"))
    discard(*left)
    if len(rounds) == 1:
        return labels
    made = materialise(labels, "labels")
    discard(*rounds)
    return made
