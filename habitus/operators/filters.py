"""Predicates and row filters: usable keys, sane amounts, clean rows, validation, duplicates and eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from habitus.config import DEFAULTS, Settings
from habitus.functions.normalize import boolish
from habitus.session import materialize
from habitus.sources.tables import ORDER


def usable_key(df: DataFrame, col: str = "origin_account_no") -> DataFrame:
    """Rows whose account number can identify an account."""
    return df.where(F.col(col).isNotNull() & ~F.col(col).isin("N/A", ""))


def is_sane(max_amount: float = DEFAULTS.max_sane_amount) -> Column:
    return F.coalesce((F.col("amount") > 0) & (F.col("amount") <= max_amount) & F.col("ts").isNotNull(), F.lit(False))


def sane_amount(df: DataFrame, max_amount: float = DEFAULTS.max_sane_amount) -> DataFrame:
    """Rows with a time and a possible amount."""
    return df.where(is_sane(max_amount))


def strict_clean(df: DataFrame) -> DataFrame:
    """Rows the profile may learn from; an unknown status or flag is not clean."""
    return df.where((F.col("status") == "clean") & ~boolish("is_blocked") & ~boolish("sender_blacklisted"))


def confirmed_fraud() -> Column:
    """Evidence of fraud for the profile gate; an unknown status alone is no evidence."""
    return F.coalesce(
        (F.col("status") != "clean") | boolish("is_blocked") | boolish("sender_blacklisted"), F.lit(False))


def weak_bad() -> Column:
    """Weak label of the model layer: any known sign of trouble; unknown values count as fine."""
    return (
        F.coalesce(F.lower("status") != "clean", F.lit(False))
        | F.coalesce(boolish("is_blocked"), F.lit(False))
        | F.coalesce(boolish("sender_blacklisted"), F.lit(False))
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], keep_null_keys: bool = False, within: tuple[str, ...] = ()) -> DataFrame:
    """One row per key, the first in a total order.

    The row_number = 1 filter lets Spark cut every map task's input to one row per key before the shuffle, so a
    key that holds a third of all rows sends at most one row per task. `within` names columns that the key decides; rows that
    are partitioned by them already are not moved.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    own = [F.when(~known, F.monotonically_increasing_id()).alias("_own")] if keep_null_keys else []  # a key of its own
    numbered = df.select("*", *own)
    w = Window.partitionBy(*within, *keys, *(["_own"] if own else [])).orderBy(*order)
    return numbered.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_own")


def dedup(df: DataFrame, keys: list[str], order: tuple[str, ...] = ORDER, keep_null_keys: bool = False, within: tuple[str, ...] = ()) -> DataFrame:
    """Keep the first copy of every key."""
    return first_per_key(df, keys, [F.col(c).asc() for c in order], keep_null_keys, within)


def latest(df: DataFrame, keys: list[str], order: tuple[str, ...]) -> DataFrame:
    """Keep the newest row of every key."""
    return first_per_key(df, keys, [F.col(c).desc() for c in order])


def bad_reasons(cfg: Settings = DEFAULTS) -> dict[str, Column]:
    return {
        "bad_amount": ~F.coalesce((F.col("amount") > 0) & (F.col("amount") <= cfg.max_sane_amount), F.lit(False)),
        "bad_timestamp": F.col("ts").isNull(),
        "no_customer_key": F.coalesce(F.length("customer_key"), F.lit(0)) == 0,
    }


def validate(df: DataFrame, cfg: Settings = DEFAULTS, within: tuple[str, ...] = ()) -> DataFrame:
    """Valid rows: first copy of each transaction id, then every independent reason must be absent. `within`: see first_per_key."""
    firsts = dedup(df, ["transaction_id"], keep_null_keys=True, within=within)
    bad = F.lit(False)
    for reason in bad_reasons(cfg).values():
        bad = bad | reason
    return firsts.where(~bad)


def validation_report(df: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """One row of counts: rows in, rows per reason (each counted on its own), rows out and customers left."""
    flags = bad_reasons(cfg)
    counts = df.agg(
        F.count("*").alias("rows_in"), *[F.count_if(f).alias(f"dropped_{n}") for n, f in flags.items()])
    copies = (
        df.where(F.col("transaction_id").isNotNull()).groupBy("transaction_id").agg((F.count("*") - 1).alias("extra"))
        .agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("dropped_duplicate_txn_id")))
    kept = (
        validate(df, cfg).groupBy("customer_key").agg(F.count("*").alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_out"), F.count("*").alias("distinct_customers")))
    one = F.lit(1).alias("_one")
    return (
        counts.select("*", one).join(copies.select("*", one), "_one").join(kept.select("*", one), "_one").drop("_one"))


def whole_days(first: Column, last: Column) -> Column:
    return F.call_function("div", F.unix_micros(last) - F.unix_micros(first), F.lit(86_400_000_000))


def ml_eligible(clean: DataFrame, min_txns: int = DEFAULTS.ml_min_txns, min_days: int = DEFAULTS.ml_min_days) -> DataFrame:
    """Customers with enough clean transactions over enough whole days, with both partial conditions."""
    per = clean.groupBy("customer_key").agg(F.count("*").alias("txns"), whole_days(F.min("ts"), F.max("ts")).alias("span_days"))
    return per.withColumns({
        "enough_txns": F.col("txns") >= min_txns, "enough_days": F.col("span_days") >= min_days,
    }).withColumn("eligible", F.col("enough_txns") & F.col("enough_days"))


def only_eligible(df: DataFrame, eligible: DataFrame) -> DataFrame:
    """Rows of eligible customers."""
    return df.join(eligible.where("eligible").select("customer_key"), "customer_key", "left_semi")


def stored_by_customer(df: DataFrame, eligible: DataFrame, label: str) -> DataFrame:
    """Rows of eligible customers, written once. The merge join leaves a customer's rows next to each other, and those of one with
    very many rows in several parts, so what is counted per customer later shrinks to a few rows before it is shuffled."""
    return materialize(df.join(eligible.where("eligible").select("customer_key").hint("merge"), "customer_key", "left_semi"), label)


def apply_feedback(df: DataFrame, feedback: DataFrame) -> DataFrame:
    """Weak label with analyst verdicts on top: fraud forces bad, genuine forces clean, no verdict changes nothing.

    Feedback must hold one row per transaction id; the fact table keeps its rows whatever the feedback's skew.
    """
    verdict = feedback.select(
        "transaction_id", F.lower(F.trim("verdict")).alias("_verdict")).where(F.col("_verdict").isin("genuine", "fraud"))
    return df.join(verdict, "transaction_id", "left").withColumn(
        "bad", F.when(F.col("_verdict") == "fraud", True).when(F.col("_verdict") == "genuine", False).otherwise(weak_bad())
    ).drop("_verdict")


def history_clean(txn: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """The rows a profile is learned from: sane, first copy per branch and transaction id, strictly clean."""
    return strict_clean(dedup(sane_amount(txn), ["branch_id", "transaction_id"], within=within))
