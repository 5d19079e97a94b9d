"""Connected components without driver-side state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.shared import materialize


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): a row (node, label) for each node, label the smallest node reachable.

    Each round hooks every node to its smallest neighbour, jumps once and contracts the edges to the labels, so that at
    least half of the nodes go; edges are combined before each shuffle and nothing is collected.
    """
    edges = materialize(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b"), "edges")
    whole = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "hook")
        up = hook.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jump = materialize(hook.join(up, "label").select("node", F.col("above").alias("label")), "jump")
        if whole is None:
            whole = jump
        else:
            further = jump.select(F.col("node").alias("label"), F.col("label").alias("above"))
            whole = materialize(whole.join(further, "label", "left").select("node", F.coalesce("above", "label").alias("label")), "labels")
        for end in ("a", "b"):
            edges = edges.join(jump.select(F.col("node").alias(end), F.col("label").alias("new")), end).drop(end).withColumnRenamed("new", end)
        edges = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if whole is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return whole
