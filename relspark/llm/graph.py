"""Connected components of an edge table, without gathering any component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspark.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """node, component (one node of each component stands for it), for every node of the edges u, v.

    Rounds of contraction: each node points to the one of its neighbours and itself that comes
    first in an order drawn anew every round, edges move to where their ends point, and loops and
    repeats go. That takes about a logarithm of the nodes in rounds whatever the graph's shape.
    Each round is written to the shared folder; the pointers are followed backwards at the end.
    Nulls and loops among the edges are left out; an empty table gives an empty one.
    """
    edges = written(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        rank = lambda c, k=len(rounds): F.struct(F.xxhash64(F.lit(k), c), c.alias("node"))
        both = edges.union(edges.select("v", "u"))
        best = both.groupBy("u").agg(F.min(rank(F.col("v"))).alias("best"))
        points = written(best.select(F.col("u").alias("node"), F.least(rank(F.col("u")), F.col("best"))["node"].alias("parent")))
        rounds.append(points)
        to = lambda end: points.select(F.col("node").alias(end), F.col("parent").alias(f"to_{end}"))
        moved = edges.join(to("u"), "u").join(to("v"), "v").where("to_u <> to_v")
        edges = written(moved.select(F.least("to_u", "to_v").alias("u"), F.greatest("to_u", "to_v").alias("v")).distinct())
    if not rounds:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = rounds.pop()
    while rounds:
        onward = found.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        found = written(rounds.pop().join(onward, "parent", "left").select("node", F.coalesce("root", "parent").alias("parent")))
    return found.withColumnRenamed("parent", "component")
