"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def _flattened(labels: DataFrame) -> DataFrame:
    """(node, root) of trees that a written table of (node, root) points along; every root is a node."""
    while True:
        ahead = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = cut_lineage(labels.join(ahead, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        labels = jumped.select("node", "root")
        if not jumped.where("moved").limit(1).count():
            return labels


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node it can reach.

    Every node points at its smallest neighbour, if that is smaller; the trees that this makes
    are flattened (a path of n nodes in log n jumps) and become the nodes of the next round,
    which has half as many at most, and only the edges between trees. Each round is written below
    the checkpoint folder; only whether something is left reaches the driver. A node with very
    many edges is one row per map task in the aggregation and is split in the joins.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(both.where("a IS NOT NULL AND b IS NOT NULL").distinct())
    found = None
    while True:
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).withColumn("root", F.least("node", "root"))
        trees = _flattened(cut_lineage(near))
        if found is None:
            found = trees
        else:  # trees of the round before that no edge leaves are whole
            last = trees.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = cut_lineage(found.join(last, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        met = (
            both.where("a < b")
            .join(trees.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
            .join(trees.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
            .where("x <> y")
        )
        both = cut_lineage(met.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(met.select(F.col("y").alias("a"), F.col("x").alias("b"))).distinct())
        if not both.limit(1).count():
            return found
