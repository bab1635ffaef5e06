"""Per-customer time windows: velocity counts, spend in the last hour, recency and the previous known value.

One customer may own a third of all rows, so no window spans a customer. Rows are partitioned by (customer, time
bucket). Each row is also sent as bare context to the two later buckets whose windows can start inside its own; the
full buckets between are covered by a per-bucket summary. Every task therefore sorts a few buckets of one customer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from habitus.config import VELOCITY_MINUTES

HOUR = 3_600_000_000
TIE = ("id", "version", "amount")


def _bucketed(df: DataFrame, ts: str, width: int) -> DataFrame:
    """Add the time in microseconds and the index of its bucket (floored, for times before 1970 too)."""
    return df.withColumn("_us", F.unix_micros(ts)).withColumn("_b", F.expr(f"(_us - pmod(_us, {width})) div {width}"))


def velocity(
    df: DataFrame, key: str = "customer_key", ts: str = "ts", tie: tuple[str, ...] = TIE,
    windows: dict[str, int] = VELOCITY_MINUTES, bucket_us: int = HOUR,
) -> DataFrame:
    """Add, per row: `n_<window>` earlier rows of the customer in [t - window, t], `spend_1h` in [t - 1h, t] with the
    row itself, and `prev_us`, the time of the customer's previous row.

    Rows with equal times are ordered by `tie`. Windows must be at most one bucket, or whole buckets.
    """
    spans = {n: m * 60_000_000 for n, m in windows.items()}
    longest = max(spans.values())
    far = longest // bucket_us
    for us in spans.values():
        if us > bucket_us and us not in (bucket_us, longest) or longest % bucket_us:
            raise ValueError("windows must fit one bucket, or be the longest one in whole buckets")
    rows = _bucketed(df, ts, bucket_us)
    across = Window.partitionBy(key).orderBy("_b")
    summary = rows.groupBy(key, "_b").agg(F.count("*").alias("_n"), F.max("_us").alias("_last"))
    full = F.coalesce(F.sum("_n").over(across.rangeBetween(-(far - 1), -2)), F.lit(0)) if far > 2 else F.lit(0)
    summary = summary.select(key, "_b", full.alias("_full"), F.lag("_last").over(across).alias("_prev_last"))

    payload = [c for c in df.columns if c not in (key, "amount", *tie)]
    carried = [c for c in dict.fromkeys(("amount", *tie)) if c in df.columns]
    shifts = sorted({0, 1, far})
    copies = rows.select(
        key, "_us", *carried, F.struct(*payload).alias("_row"), F.col("_b").alias("_home"),
        F.explode(F.array(*[F.lit(s).cast("long") for s in shifts])).alias("_shift"))
    own = F.col("_shift") == 0
    copies = copies.select(
        key, "_us", *carried, F.when(own, F.col("_row")).alias("_row"), (F.col("_home") + F.col("_shift")).alias("_b"), own.alias("_own"))
    placed = copies.join(summary, [key, "_b"])
    ordered = Window.partitionBy(key, "_b").orderBy("_us", *tie)
    timed = Window.partitionBy(key, "_b").orderBy("_us")

    def older(us: int) -> Window:
        return timed.rangeBetween(Window.unboundedPreceding, -(us + 1))

    money = F.col("amount").cast("decimal(18,2)")
    placed = placed.withColumns({
        "_pos": F.row_number().over(ordered) - 1,
        "_paid": F.sum(money).over(ordered.rowsBetween(Window.unboundedPreceding, 0)),
        "_lag": F.when(F.lag("_own").over(ordered), F.lag("_us").over(ordered)),
    })
    placed = placed.withColumns(
        {f"n_{n}": F.col("_pos") - F.count("*").over(older(us)) + (F.col("_full") if us > bucket_us else F.lit(0)) for n, us in spans.items()}
        | {"spend_1h": (F.col("_paid") - F.coalesce(F.sum(money).over(older(HOUR)), F.lit(0))).cast("double")})
    return placed.where("_own").select(
        key, *carried, *[F.col(f"_row.{c}").alias(c) for c in payload], *[f"n_{n}" for n in spans],
        "spend_1h", F.coalesce("_lag", "_prev_last").alias("prev_us"))


def velocity_features(counted: DataFrame, median: Column, ts: str = "ts", cap_hours: int = 720) -> DataFrame:
    """Squashed features from the raw windows; `median` is the customer's usual amount (0 counts as 1)."""
    usual = F.coalesce(F.nullif(median, F.lit(0.0)), F.lit(1.0))
    gap = (F.unix_micros(ts) - F.col("prev_us")) / 3.6e9
    out = counted.withColumns({n: F.log1p(F.col(f"n_{n}").cast("double")) for n in VELOCITY_MINUTES} | {
        "amt_1h_ratio": F.coalesce(F.log1p(F.col("spend_1h") / usual), F.lit(0.0)),
        "recency_hours": F.coalesce(F.least(F.greatest(gap, F.lit(0.0)), F.lit(float(cap_hours))), F.lit(0.0)),
    })
    return out.drop(*[f"n_{n}" for n in VELOCITY_MINUTES], "spend_1h", "prev_us")


def previous_value(
    df: DataFrame, value: Column, name: str, key: str = "customer_key", ts: str = "ts", tie: tuple[str, ...] = ("id", "version"),
    bucket_us: int = 24 * HOUR,
) -> DataFrame:
    """Add `name`: the last non-null `value` of an earlier row of the same key, however long ago.

    The answer is in the row's own bucket, or else it is the newest value of an earlier bucket, found in the summary.
    """
    rows = _bucketed(df.withColumn("_v", value), ts, bucket_us)
    order = F.struct("_us", *tie)
    summary = rows.groupBy(key, "_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), order)).alias("_last"))
    across = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(key, "_b", F.last("_last", ignorenulls=True).over(across).alias("_earlier"))
    inside = Window.partitionBy(key, "_b").orderBy("_us", *tie).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(summary, [key, "_b"]).withColumn(
        name, F.coalesce(F.last("_v", ignorenulls=True).over(inside), F.col("_earlier"))).drop("_v", "_us", "_b", "_earlier")


def history_before(df: DataFrame, probes: DataFrame, hours: int = 24, key: str = "customer_key") -> DataFrame:
    """The rows of each probe's customer in [t - hours, t).

    The join is on (customer, hour): a probe looks only into the hours its range touches, so a busy customer is
    spread over many join keys. The output is the requested history itself; for totals use `velocity`.
    """
    span = hours * HOUR
    wanted = _bucketed(probes.select(F.col(key), F.col("transaction_id").alias("probe_id"), F.col("ts").alias("probe_ts")), "probe_ts", HOUR)
    wanted = wanted.withColumn("_b", F.explode(F.sequence(F.col("_b") - hours, F.col("_b")))).withColumnRenamed("_us", "_at")
    rows = _bucketed(df, "ts", HOUR)
    return rows.join(wanted, [key, "_b"]).where(
        (F.col("_us") < F.col("_at")) & (F.col("_us") >= F.col("_at") - span)).drop("_us", "_at", "_b")
