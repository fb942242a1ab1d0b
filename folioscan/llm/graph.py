"""Connected components of an edge table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v.  Large star links each node's larger
    neighbours to its smallest neighbour, small star its smaller ones and
    itself.  The smallest neighbour is aggregated before the join, so a node
    with very many neighbours costs one row per task in that exchange."""
    near = (
        edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if large
        else edges
    )
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = near.join(least, "u")
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) pairs of comparable node ids -> (node, root): the smallest id
    that a node reaches.  Nodes without edges do not appear."""
    now = materialize(
        edges.filter("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    for _ in range(rounds):
        then = now
        now = materialize(_star(_star(then, True), False), "edges")
        # both are sets of edges: equal if as large and nothing of one is missing in the other
        same = now.count() == then.count() and now.join(then, ["u", "v"], "left_anti").isEmpty()
        drop(then)
        if same:
            break
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
