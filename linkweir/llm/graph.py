"""Connected components of an edge table, by alternating large and small stars (O(log n) rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


#: Edges for each task of a round, beyond the first eight tasks.
EDGES_OF_TASK = 100_000


def _star(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """One star step on edges (u, v) with u > v. Minima are written before the join, so a hot node's rows can be split."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "minima", parts)
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return materialize(out.where(F.col("u") != F.col("v")).distinct(), "edges", parts)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b), of one kind: root is the least node of its component."""
    now = materialize(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (state["n"], state["s"]) == mark or not state["n"]:
            break
        mark = (state["n"], state["s"])
        parts = 8 + state["n"] // EDGES_OF_TASK
        now = _star(_star(now, True, parts), False, parts)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
