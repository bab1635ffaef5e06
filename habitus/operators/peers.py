"""Peer-group baselines: what is usual for a branch, account type and currency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from habitus.config import DEFAULTS, Settings
from habitus.functions.normalize import account_type, city_of, exact_sum, normalize_currency
from habitus.operators.ordered import quantiles
from habitus.operators.profile import histogram

GROUP = ("branch_id", "account_type", "currency")


def with_peer_group(clean: DataFrame) -> DataFrame:
    """Canonical account type and currency, so that every row belongs to one peer group."""
    return clean.withColumns({
        "account_type": account_type("account_type"), "currency": normalize_currency("currency"), "city": city_of("customer_location")})


def peer_top(rows: DataFrame, col: str, name: str, cfg: Settings = DEFAULTS) -> DataFrame:
    w = Window.partitionBy(*GROUP).orderBy(F.col("n").desc(), "value")
    counts = rows.where(F.col(col) != "").groupBy(*GROUP, F.col(col).alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cfg.top_n).groupBy(*GROUP).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias(name))


def peer_hours(rows: DataFrame) -> DataFrame:
    return histogram(rows, GROUP, "hour").drop("top_hour")


def peer_baselines(clean: DataFrame, months: Column, cfg: Settings = DEFAULTS) -> DataFrame:
    """One row per peer group. A group may hold most of the data, so distinct entities are counted from per-entity
    partial sums and quantiles from binned counts; no group is ever gathered in one task."""
    rows = with_peer_group(clean)
    per_entity = rows.groupBy(*GROUP, "entity_key").agg(F.count("*").alias("n"))
    size = per_entity.groupBy(*GROUP).agg(F.count("*").alias("peer_entities"))
    amounts = rows.groupBy(*GROUP).agg(
        F.count("*").alias("peer_tx_count"), (exact_sum("amount") / F.count("*")).alias("avg_amount"),
        F.max("amount").alias("max_amount"), F.stddev_samp("amount").alias("std_amount"))
    out = amounts.join(size, list(GROUP))
    for part in (
        quantiles(rows, "amount", {"median_amount": 0.5, "p95_amount": 0.95}, GROUP),
        peer_top(rows, "city", "usual_cities", cfg), peer_top(rows, "origin_country", "usual_countries", cfg), peer_hours(rows),
    ):
        out = out.join(part, list(GROUP), "left")
    return out.withColumn("avg_monthly_tx_count", F.col("peer_tx_count") / months / F.col("peer_entities"))
