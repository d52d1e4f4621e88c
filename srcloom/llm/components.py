"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge, root being the least node it can reach.

    edges has columns a and b of one orderable type; direction, repeats, loops
    and nulls don't matter. Each round replaces the edges by stars with fewer
    levels, so a chain of n nodes takes about log n rounds; rows never exceed
    the edges there were. Every round is kept in the shared folder. An empty
    table gives an empty table.
    """
    plain = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.col("a").isNull().alias("__x"), F.col("b").isNull().alias("__y"))
    now = durable(plain.where("a <> b and not __x and not __y").select("a", "b").distinct())
    mark = _mark(now)
    for _ in range(max_rounds):
        # large star: neighbours above a node go to its least neighbour
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: neighbours below a node, and the node, go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        now = durable(small)
        was, mark = mark, _mark(now)
        if was == mark:
            roots = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _mark(edges: DataFrame) -> tuple:
    """The same for the same set of edges; differs, in all likelihood, for others."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
