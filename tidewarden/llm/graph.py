"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden.llm.common import forget, keep


def _least(arcs: DataFrame) -> DataFrame:
    """Each node with the least of its neighbours and itself; sums up before the shuffle."""
    return arcs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (a, b); component is the least node reachable.

    Edges may repeat and point either way; loops and nulls are ignored. Every round is written to
    the shared folder. A hub's arcs meet only in sums and in joins that Spark can split.
    """
    edges = edges.where("a is not null and b is not null and a != b")
    edges = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        # Large star: larger neighbours move to the least neighbour.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = keep(large.distinct(), "edges")
        # Small star: smaller neighbours and the node itself move to the least one.
        small = large.join(_least(large), "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        small = keep(small.where("a != b").distinct(), "edges")
        roots = small.agg(F.count("*").alias("n"), F.count_distinct("a").alias("nodes")).first()
        inner = small.select(F.col("b").alias("a")).distinct().join(small.select("a").distinct(), "a", "left_semi")
        forget(edges, large)
        edges = small
        if roots["n"] == roots["nodes"] and inner.isEmpty():  # every node hangs on a root
            break
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
