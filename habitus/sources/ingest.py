"""Incremental ingest: bounded extracts, watermarks, refresh windows, upserts, rejects and pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from habitus.operators.filters import first_per_key, latest, usable_key

EXTRACT_ORDER = ("ts", "id", "version", "amount")


def window_start(as_of: Column, months: int) -> Column:
    return F.add_months(as_of, -months).cast("timestamp") + (as_of - F.date_trunc("day", as_of))


def extract_window(df: DataFrame, as_of: Column, months: int = 3, branch: int | None = None, limit: int | None = None,
                   order: tuple[str, ...] = EXTRACT_ORDER) -> DataFrame:
    """Rows with a usable account inside the lookback window; filters reach the scan, and a limit takes the earliest rows."""
    out = usable_key(df).where(F.col("ts") >= window_start(as_of, months))
    if branch is not None:
        out = out.where(F.col("branch_id") == branch)
    return out.orderBy(*order).limit(limit) if limit else out


def pull_new(df: DataFrame, last_id: int | Column, cap: int | None = None, order: tuple[str, ...] = ("id", "version", "amount")) -> DataFrame:
    """Rows beyond the watermark; with a cap, the next `cap` rows in id order (top-k, not a full sort)."""
    out = usable_key(df).where(F.col("id") > last_id)
    return out.orderBy(*order).limit(cap) if cap else out


def pull_refresh(df: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Everything of the last days again, so that changed statuses are picked up."""
    return usable_key(df).where(F.col("ts") >= as_of - F.expr(f"INTERVAL '{int(days)}' DAY"))


def remaining(df: DataFrame, last_id: int | Column, as_of: Column, months: int = 3) -> DataFrame:
    """How many rows are still to pull."""
    return extract_window(df, as_of, months).where(F.col("id") > last_id).agg(F.count("*").alias("remaining"))


def union_latest(old: DataFrame, new: DataFrame, keys: list[str], order: tuple[str, ...] = ()) -> DataFrame:
    """Union by name in which a newer row replaces an older one with the same key."""
    both = old.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)))
    return latest(both, keys, ("_gen", *order)).drop("_gen")


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], order: tuple[str, ...]) -> DataFrame:
    """Merge a delta into a table on its key; within the delta the row that is last in `order` wins.

    The delta is reduced to one row per key first. Unchanged rows of the base are kept by an anti join, so the base is
    shuffled only when the delta is too large to broadcast, and never sorted.
    """
    winners = latest(delta, keys, order)
    return base.join(winners.select(*keys), keys, "left_anti").unionByName(winners)


def upsert_coalesce(base: DataFrame, delta: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Merge in which a null in the delta keeps the stored value."""
    new = delta.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in cols])
    return base.select(*keys, *cols).join(new, keys, "full_outer").select(*keys, *[F.coalesce(f"_n_{c}", c).alias(c) for c in cols])


def prune(df: DataFrame, as_of: Column, months: int = 3) -> DataFrame:
    """Rows inside the learning window; on a day-partitioned table the filter drops whole partitions."""
    return df.where(F.col("ts") >= window_start(as_of, months))


def split_rejects(df: DataFrame, constraints: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet every constraint, and the others with the names of those they break."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), n) for n, ok in constraints.items()]
    checked = df.withColumn("reasons", F.array_compact(F.array(*broken)))
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)


def advance_watermark(state: DataFrame, batch: DataFrame, source: str) -> DataFrame:
    """New sync state of a source: the id watermark never moves back, rows accumulate, freshness is the newest time."""
    seen = batch.agg(F.max("id").alias("_id"), F.count("*").alias("_n"), F.max("ts").alias("_ts")).withColumn("source", F.lit(source))
    return state.join(seen, "source", "left").select(
        "source", F.coalesce(F.greatest("last_id", "_id"), F.col("last_id")).alias("last_id"),
        (F.col("rows_total") + F.coalesce("_n", F.lit(0))).alias("rows_total"),
        F.coalesce(F.greatest("newest", "_ts"), F.col("newest")).alias("newest"),
        F.when(F.coalesce("_n", F.lit(0)) > 0, "ok").otherwise("idle").alias("last_status"))


def load_ml(df: DataFrame, as_of: Column, months: int = 3, sample: float | None = None, limit: int | None = None) -> DataFrame:
    """Model input: rows with a customer inside the window; the optional sample is a function of the row, not of chance."""
    out = df.where(F.col("identifier").isNotNull() & (F.col("ts") >= window_start(as_of, months)))
    if sample is not None:
        digits = F.conv(F.substring(F.md5(F.concat_ws("|", "transaction_id", "version")), 1, 8), 16, 10).cast("long")
        out = out.where(digits < int(sample * 2**32))
    return out.orderBy("customer_key", *EXTRACT_ORDER).limit(limit) if limit else out
