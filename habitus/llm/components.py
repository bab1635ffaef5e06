"""Connected components by alternating large and small stars, every round written to shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from habitus.llm.text import stored


def star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step on (u, v) with u > v. Minima are pre-aggregated; the join on a busy node is left to skew handling."""
    both = edges if small else edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    if not small:
        least = least.select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u").filter(F.col("m") != F.col("v"))
    moved = moved.select("v", "m") if small else moved.filter("v > u").select("v", "m")
    own = least.filter(F.col("m") < F.col("u")).select(F.col("u").alias("v"), "m")
    out = moved.union(own)
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b) that isn't its component's least node."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links")
    state = None
    while True:
        edges = stored(star(star(edges, small=False), small=True), "stars")
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now
