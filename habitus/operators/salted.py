"""Joins of transactions with one row a key, for keys that may hold a third of all transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SHARE = 16_384  # a key with over one in so many of all rows is split, so at most this many keys are
LEAST = 100_000  # rows of a part, at least
SPREAD = ("ts", "id", "version", "transaction_id", "amount")  # what tells the rows of a key apart


def hot_keys(counted: DataFrame, key: str, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """(key, parts) of the keys to split, from their frequencies: at most `share` rows, and 2 * `share` parts in all."""
    counts = counted.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    part = F.greatest(F.lit(least), counted.agg(F.count("*") / share).scalar())
    return counts.where(F.col("_n") > part).select(key, F.ceil(F.col("_n") / part).cast("int").alias("_parts"))


def salted_join(
    rows: DataFrame, side: DataFrame, key: str, counted: DataFrame | None = None, spread: tuple[str, ...] = SPREAD,
    least: int = LEAST, share: int = SHARE,
) -> DataFrame:
    """rows left-joined with `side`, which has one row a key; the rows of frequent keys meet copies of it in several parts.

    Frequencies are counted on `counted`, a cheaper frame with the same keys, or else on the rows. The frequent keys have a
    proven bound, so they are broadcast. Rows without a key match nothing and spread over the parts. A part is chosen by a
    hash of what `spread` names, so a repeated task sends each row to where it went before.
    """
    hot = F.broadcast(hot_keys(counted if counted is not None else rows, key, least, share))
    known = [F.col(c) for c in spread if c in rows.columns]
    deal: Column = F.xxhash64(*known) if known else F.xxhash64(F.lit(0))
    parts = F.when(F.col(key).isNull(), share).otherwise(F.coalesce("_parts", F.lit(1)))
    dealt = rows.join(hot, key, "left").withColumn("_salt", F.pmod(deal, parts).cast("int")).drop("_parts")
    copies = side.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copies, [key, "_salt"], "left").drop("_salt")
