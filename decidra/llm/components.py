"""Connected components by alternating large-star and small-star steps, each step a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decidra.llm._common import drop, stage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b) with a > b; each node's smallest neighbour is found with partial aggregation."""
    if large:
        seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        seen = edges
    least = seen.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = seen.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def _done(edges: DataFrame) -> bool:
    """Whether all edges (a, b) are stars: no node has two smaller neighbours, or both a smaller and a larger one."""
    sides = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("s"))
    each = sides.groupBy("s.node").agg(F.sum("s.up").alias("up"), F.min("s.up").alias("least"))
    return not each.filter("up > 1 OR (up > 0 AND least = 0)").limit(1).count()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with a link; a component's name is its smallest node. Loops link nothing."""
    spark = links.sparkSession
    whole = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    edges, at = stage(whole, "edges", most_rows=links.count())
    while not _done(edges):  # a step makes no more edges than there were, and one for each node
        n = 3 * edges.count()
        large, large_at = stage(_stars(edges, True), "edges", most_rows=n)
        edges, next_at = stage(_stars(large, False), "edges", most_rows=n)
        drop(spark, at, large_at)
        at = next_at
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
