"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, component) for every node of the undirected edges (a, b), component = its smallest node.

    Each round links every node's larger neighbours to its smallest one, then its smaller ones,
    until the edges are stars; the number of rounds grows with the logarithm of the longest
    path. ``written`` materialises a round's edges; no round holds more edges than came in
    plus one a node, and a hub's edges are combined before they are shuffled.
    """
    def digest(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "low").cast("decimal(38,0)"))).first())

    stars = written(edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("low"))
                    .where(F.col("node") != F.col("low")).distinct())
    before = digest(stars)
    while before[0]:
        ways = stars.select("node", F.col("low").alias("other")).unionByName(
            stars.select(F.col("low").alias("node"), F.col("node").alias("other")))
        least = ways.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
        large = ways.join(least, "node").where(F.col("other") > F.col("node")).select(
            F.col("other").alias("node"), F.col("least").alias("low")).distinct()
        least = large.groupBy("node").agg(F.min("low").alias("least"))
        small = large.join(least, "node").where(F.col("low") != F.col("least")).select(
            F.col("low").alias("node"), F.col("least").alias("low"))
        stars = written(small.unionByName(least.withColumnRenamed("least", "low")).distinct())
        now = digest(stars)
        if now == before:
            break
        before = now
    nodes = stars.select(F.col("node").alias("id"), F.col("low").alias("component"))
    return nodes.unionByName(stars.select(F.col("low").alias("id"), F.col("low").alias("component")).distinct())
