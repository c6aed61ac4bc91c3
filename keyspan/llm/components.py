"""Connected components of links, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.llm.common import settled


def connected(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of `links` (a, b); one row for each node.

    Alternating large-star and small-star steps: each step joins or groups the links by node, no component is ever
    gathered, and the number of links never grows. A node with very many links is one row of each of its neighbours.
    """
    edges = settled(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    while True:
        # Large star: every larger neighbour of u is linked to the smallest node that u knows.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        # Small star: every smaller neighbour of u, and u itself, is linked to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        new = settled(small)
        same = new.count() == edges.count() and new.exceptAll(edges).isEmpty()
        edges = new
        if same:
            break
    nodes = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.union(nodes.select(F.col("component").alias("node"), "component").distinct())
