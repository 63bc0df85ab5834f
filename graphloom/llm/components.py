"""Connected components of an edge table, without collecting nodes or edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(a long, b long) undirected -> (node, root): root is one node of the component, the same for all its nodes.

    Each round hooks every node to its smallest neighbour where that is
    smaller, and replaces the edges by those between the hooks. A round's
    minimum is aggregated before the shuffle, so a hub costs no more than its
    edges; the number of rounds is logarithmic in practice. An empty table
    gives an empty table.
    """
    live = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = None
    while not live.isEmpty():
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")), "hooks")
        if found is None:
            found = hook.select("node", F.col("up").alias("root"))
        else:
            moved = found.join(hook, found.root == hook.node, "left").select(found.node, F.coalesce(hook.up, found.root).alias("root"))
            found = materialize(moved, "found")
        x, y = hook.select(F.col("node").alias("a"), F.col("up").alias("ua")), hook.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        step = live.join(x, "a").join(y, "b").where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct()
        old, live = live, materialize(step, "edges")
        drop_scratch(old)
    if found is None:
        found = live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
