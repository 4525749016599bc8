"""Connected components of a graph whose edges lie in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from specloom.session import stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    lower = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def component_roots(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v: longs), root being the smallest node reachable.

    Alternates between hanging larger neighbours and smaller neighbours on the least one until all edges form stars; the
    number of rounds grows with the logarithm of the longest path. Edges from a node to itself may be left out.
    """

    def mark(df: DataFrame):
        # Two sums of hashes: the same edges give the same mark.
        row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007), F.sum(F.hash("v", "u").cast("long"))).first()
        return tuple(row)

    current = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before = mark(current)
    while before[0]:
        current = stage(_small_star(_large_star(current)), "edges")
        now = mark(current)
        if now == before:
            break
        before = now
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
