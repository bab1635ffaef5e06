"""The bipartite customer-to-counterparty graph: popularity, per-customer features, node numbering and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from habitus.operators.ordered import dense_index


def edge_counts(df: DataFrame) -> DataFrame:
    """Distinct (customer, counterparty) pairs with their number of transactions; unknown counterparties drop out."""
    return df.where(F.col("destination_account_no").isNotNull()).groupBy("customer_key", "destination_account_no").agg(F.count("*").alias("n"))


def popularity(edges: DataFrame) -> DataFrame:
    """How many distinct customers pay each counterparty."""
    return edges.groupBy("destination_account_no").agg(F.count("*").alias("cp_pop"))


def with_popularity(edges: DataFrame) -> DataFrame:
    """Popularity on every pair. A collector account's pairs are many, but the popularity side holds one row per
    counterparty: adaptive execution broadcasts it when small and splits the skewed side when not."""
    return edges.join(popularity(edges), "destination_account_no")


def graph_features(df: DataFrame) -> DataFrame:
    """Per customer: log of distinct beneficiaries, distinct share of all payments, log of the most popular counterparty."""
    return edge_features(edge_counts(df))


def edge_features(edges: DataFrame) -> DataFrame:
    """graph_features of edges that are counted already."""
    return with_popularity(edges).groupBy("customer_key").agg(
        (F.count("*") / F.sum("n")).alias("g_fanout"), F.log1p(F.count("*").cast("double")).alias("g_distinct_benef"),
        F.log1p(F.max("cp_pop").cast("double")).alias("g_shared_cp"))


def with_graph(features: DataFrame, graph: DataFrame) -> DataFrame:
    """Add graph features; customers without any have zeros."""
    return features.join(graph, "customer_key", "left").fillna(0.0, ["g_fanout", "g_distinct_benef", "g_shared_cp"])


def build_edges(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered nodes (customers first, then counterparties; 0..n-1) and numbered distinct edges with their weight; of transactions, or
    of edges that are counted already."""
    edges = (df if "n" in df.columns else edge_counts(df)).select(
        F.concat(F.lit("cu:"), "customer_key").alias("src_name"), F.concat(F.lit("cp:"), "destination_account_no").alias("dst_name"), "n")
    names = edges.select(F.col("src_name").alias("node")).distinct().withColumn("side", F.lit(0)).unionByName(
        edges.select(F.col("dst_name").alias("node")).distinct().withColumn("side", F.lit(1)))
    nodes = dense_index(names, "node", F.md5("node"), "node_id", first=F.col("side"))
    src = nodes.select(F.col("node").alias("src_name"), F.col("node_id").alias("src"))
    dst = nodes.select(F.col("node").alias("dst_name"), F.col("node_id").alias("dst"))
    return nodes, edges.join(src, "src_name").join(dst, "dst_name").select("src", "dst", "n")
