"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steppe.llm.shared import materialize


def _roots(parents: DataFrame) -> DataFrame:
    """The root above each node: every round doubles the steps that are taken."""
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        jumped = materialize(parents.join(above, "parent").select("node", "parent", "root"), "graph-roots")
        parents = jumped.select("node", F.col("root").alias("parent"))
        if jumped.filter("parent <> root").isEmpty():
            return parents.withColumnRenamed("parent", "root")


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and label (the least node of its component) for all ends of edges.

    Each round hangs every node under its least neighbour, finds the roots, and
    contracts the edges to edges between roots. At least half of the nodes that
    still have edges vanish, so there are few rounds, and dense groups shrink to
    a node at once. Tables are written between rounds. A node with very many
    edges is a partial minimum of many tasks, not one task's rows.

    Repeated edges and loops change nothing, an edge with a null end is none,
    nodes without edges have no row, and an empty table gives no rows.
    """
    low, high = F.least(a, b).alias("a"), F.greatest(a, b).alias("b")
    edges = materialize(edges.select(low, high).filter("a < b").distinct(), "graph-edges")
    labels = None
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
        both = both.unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        least = both.groupBy("node").agg(F.min("other").alias("other"))
        parents = materialize(least.select("node", F.least("node", "other").alias("parent")), "graph-parents")
        roots = _roots(parents)
        if labels is None:
            labels = roots.select("node", F.col("root").alias("label"))
        else:
            moved = roots.select(F.col("node").alias("label"), F.col("root"))
            labels = labels.join(moved, "label", "left").select("node", F.coalesce("root", "label").alias("label"))
            labels = materialize(labels, "graph-labels")
        for end in ("a", "b"):
            edges = edges.join(roots.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("root", end)
        edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
        edges = materialize(edges, "graph-edges")
        if edges.isEmpty():
            return labels
