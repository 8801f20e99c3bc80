"""Connected components of an edge table, distributed, by contraction: every node points to its smallest neighbour or is a
root if it has no smaller one, pointers jump to their roots, and only the edges between different roots go on.

Two rounds at least halve the nodes: a root that nothing points to has a smaller root as neighbour in the next round, and
the other roots are no more than the nodes that pointed. Jumps double the way, so a round takes the logarithm of its
longest path of pointers, and nothing bounds the size or shape of a component. Tables of past steps are deleted.

Defined results: edges with a null end and edges of a node to itself are left out, repeated ones count once, and an empty
table gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def rooted(near: DataFrame) -> DataFrame:
    """near (node, label), a written table of labels no larger than their nodes and nodes themselves -> each node with its root."""
    while True:
        far = near.select(F.col("node").alias("label"), F.col("label").alias("far"))
        jumped = materialize(near.join(far, "label").select("node", F.col("far").alias("label"), (F.col("far") != F.col("label")).alias("moved")), "labels")
        discard(near)
        if jumped.filter("moved").isEmpty():
            return jumped
        near = jumped


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (id, component): the smallest id that is reachable. Nodes without edges don't appear."""
    live = materialize(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    known = None
    while True:
        ends = live.select(F.col("a").alias("node"), F.col("b").alias("other")).union(live.select("b", "a"))
        near = materialize(ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("label")), "near")
        labels = rooted(near)
        of_a = labels.select(F.col("node").alias("a"), F.col("label").alias("label_a"))
        of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("label_b"))
        across = live.join(of_a, "a").join(of_b, "b").filter("label_a != label_b")
        left = materialize(across.select(F.least("label_a", "label_b").alias("a"), F.greatest("label_a", "label_b").alias("b")).distinct(), "edges")
        if known is None:
            moved = labels.select(F.col("node").alias("id"), F.col("label").alias("component"))
        else:
            joined = known.join(labels, known["component"] == labels["node"], "left")
            moved = joined.select("id", F.coalesce("label", "component").alias("component"))
        found = materialize(moved, "components")
        discard(live, labels, *([known] if known is not None else []))
        live, known = left, found
        if live.isEmpty():
            discard(live)
            return known
