"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of edges (a, b): root is one node of its component. No edges give no rows.

    Every node hooks to its least neighbour if that is smaller; pointer jumping makes the resulting trees stars, and
    edges between different stars are contracted until none is left: each round at least halves what is left, so
    rounds grow with the logarithm of the nodes, as do the jumps within a round.
    """
    edges = common.checkpoint(edges.where("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct())
    nodes = edges.selectExpr("a node").union(edges.selectExpr("b node")).distinct()
    found = nodes.selectExpr("node", "node root")
    while not edges.isEmpty():
        up = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        up = common.checkpoint(up)
        while True:
            over = up.selectExpr("node root", "root top")
            jumped = common.checkpoint(up.join(over, "root", "left").selectExpr("node", "coalesce(top, root) root", "top is not null as moved"))
            moved = not jumped.where("moved").isEmpty()
            up = jumped.drop("moved")
            if not moved:
                break
        found = common.checkpoint(found.join(up.selectExpr("node root", "root top"), "root", "left").selectExpr("node", "coalesce(top, root) root"))
        up = up.selectExpr("node a", "root top")
        edges = edges.join(up, "a", "left").selectExpr("coalesce(top, a) a", "b")
        edges = edges.join(up.selectExpr("a b", "top"), "b", "left").selectExpr("a", "coalesce(top, b) b")
        edges = common.checkpoint(edges.where("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct())
    return found
