"""Connected components of a graph given by its edges, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import staged


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b); the label is a node of the component.

    Each round maps every node to the least of itself and its neighbours and contracts the edges. The graph shrinks until
    no edge is left; the maps are then followed in turn. Self-loops and repeated edges do no harm.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    nodes = staged(both, "edges")
    left, maps = nodes.filter("a <> b"), []
    while not left.isEmpty():
        parents = staged(left.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")), "parents")
        maps.append(parents)
        to_a, to_b = (parents.select(F.col("a").alias(f"n{x}"), F.col("p").alias(f"p{x}")) for x in "ab")
        moved = left.join(to_a, F.col("a") == F.col("na")).join(to_b, F.col("b") == F.col("nb"))
        left = staged(moved.select(F.col("pa").alias("a"), F.col("pb").alias("b")).filter("a <> b").distinct(), "contracted")
    labels = nodes.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    for parents in maps:
        to = parents.select(F.col("a").alias("n"), F.col("p"))
        labels = labels.join(to, F.col("label") == F.col("n"), "left").select("node", F.coalesce("p", "label").alias("label"))
    return staged(labels, "components")
