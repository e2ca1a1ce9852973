"""Connected components of an edge table, on Spark tables throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store, watched


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; the root is the least node that can be reached.

    Alternates two steps on a table of edges (node, smaller neighbour): each node
    hands its larger neighbours, then its smaller ones, to the least node it
    knows. The minimum per node combines before the shuffle, and the join that
    hands it out may split a node with many neighbours. The steps end when they
    change nothing, which the job that stores a step finds on the way; as every step
    is stored, lost executors cost one step.
    """

    def hand_out(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return pairs.join(least, "u")

    def larger(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        return hand_out(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))

    def smaller(e: DataFrame) -> DataFrame:
        given = hand_out(e.select(F.col("a").alias("u"), F.col("b").alias("v")))
        return given.select(F.col("v").alias("a"), F.col("m").alias("b")).union(given.select(F.col("u").alias("a"), F.col("m").alias("b")))

    def kept(e: DataFrame) -> tuple[DataFrame, dict]:
        noted, seen = watched(e.distinct(), hashes=F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")))
        return store(noted, "edges"), seen.get

    now, before = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while before["rows"]:
        now, after = kept(smaller(larger(now)).where("a <> b"))
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
