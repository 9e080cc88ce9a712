"""Connected components of a graph that is larger than any task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import cut_lineage


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of edges (a, b); root is a node of the component, the same for all of it.

    In each round every node moves to the least of itself and its neighbours, and edges move along; as
    names are hashes, a round shrinks any graph by a constant factor. Nodes with many edges are counted
    map-side, and joins see stored tables, so that Spark can split a hot node.
    """
    edges = cut_lineage(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    roots = None
    while True:
        both = edges.select(F.col("a").alias("node"), F.least("a", "b").alias("to")).unionAll(
            edges.select(F.col("b").alias("node"), F.least("a", "b").alias("to")))
        moves = cut_lineage(both.groupBy("node").agg(F.min("to").alias("to")))
        if roots is None:
            roots = moves.select("node", F.col("to").alias("root"))
        else:
            step = moves.select(F.col("node").alias("root"), "to")
            roots = cut_lineage(roots.join(step, "root", "left").select(
                "node", F.coalesce("to", "root").alias("root")))
        a = moves.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        b = moves.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        edges = cut_lineage(edges.join(a, "a").join(b, "b").where(F.col("to_a") != F.col("to_b")).select(
            F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct())
        if edges.isEmpty():
            return roots
