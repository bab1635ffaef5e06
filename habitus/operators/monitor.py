"""Monitoring of live decisions: flag rate, precision, retrain trigger, alerts, feedback links and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from habitus.config import DEFAULTS, Settings
from habitus.functions.normalize import canonical_verdict, days_between
from habitus.operators.baseline import bin_shares, psi
from habitus.operators.filters import first_per_key, latest
from habitus.operators.ordered import quantiles
from habitus.operators.velocity import previous_value

FLAGGED = ("review", "unsafe")


def check_live(decisions: DataFrame, as_of: Column, hours: int = DEFAULTS.live_window_hours, cfg: Settings = DEFAULTS) -> DataFrame:
    """Share of flagged decisions in the window against its band; too few decisions make no judgement."""
    recent = decisions.where(F.col("scored_at") > as_of - F.expr(f"INTERVAL '{int(hours)}' HOUR"))
    counts = recent.agg(F.count("*").alias("total"), F.count_if(F.col("decision").isin(*FLAGGED)).alias("flagged"), F.count_if(F.col("decision") == "unsafe").alias("unsafe"))
    rate = F.coalesce(F.try_divide("flagged", "total"), F.lit(0.0))
    enough = F.col("total") >= cfg.live_min_sample
    problems = F.array_compact(F.array(
        F.when(enough & (rate > cfg.flag_rate_max), "over-flagging"), F.when(enough & (rate < cfg.flag_rate_min), "under-flagging")))
    return counts.withColumns({"flag_rate": F.round(rate, 4), "enough": enough, "problems": problems}).withColumn("healthy", F.size("problems") == 0)


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The newest decision of every transaction."""
    return latest(decisions.where(F.col("transaction_id").isNotNull()), ["transaction_id"], ("scored_at", "id"))


def decisions_with_verdict(decisions: DataFrame, feedback: DataFrame, as_of: Column, days: int = DEFAULTS.precision_window_days) -> DataFrame:
    """Latest decisions next to the analyst verdicts of the window."""
    recent = feedback.where(F.col("created_at") > as_of - F.expr(f"INTERVAL '{int(days)}' DAY"))
    return latest_decisions(decisions).join(recent.select("transaction_id", F.lower("verdict").alias("verdict")), "transaction_id")


def live_precision(decisions: DataFrame, feedback: DataFrame, as_of: Column, days: int = DEFAULTS.precision_window_days, cfg: Settings = DEFAULTS) -> DataFrame:
    """Confusion counts, precision and recall of the live model; null rates until there are enough labels."""
    both = decisions_with_verdict(decisions, feedback, as_of, days)
    flagged, fraud = F.col("decision").isin(*FLAGGED), F.col("verdict") == "fraud"
    counts = both.agg(
        F.count_if(flagged & fraud).alias("tp"), F.count_if(flagged & ~fraud).alias("fp"),
        F.count_if(~flagged & fraud).alias("fn"), F.count_if(~flagged & ~fraud).alias("tn"))
    labels = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    enough = labels >= cfg.min_labels
    return counts.withColumns({
        "labels": labels, "enough": enough, "precision": F.when(enough, F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 4)),
        "recall": F.when(enough, F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 4))})


def model_retrain_trigger(watermark: DataFrame, cache: DataFrame, as_of: Column, cfg: Settings = DEFAULTS) -> DataFrame:
    """Whether the model is due: enough new rows, enough days, or enough drift of amounts since its watermark."""
    since = watermark.select("max_date").scalar()
    fresh = cache.where(F.col("ts") > since)
    counted = fresh.agg(F.count("*").alias("new_transactions"))
    shares = bin_shares(fresh.where("amount > 0"), watermark.select("edges").scalar())
    one = F.lit(1).alias("_one")
    out = watermark.select("max_date", "ref_share", one).join(counted.select("*", one), "_one").join(shares.select("share", one), "_one", "left")
    out = out.withColumns({
        "age_days": F.floor(days_between(as_of, "max_date")), "amount_psi": F.round(psi(F.col("ref_share"), F.col("share")), 4)})
    reasons = F.array_compact(F.array(
        F.when(F.col("new_transactions") >= cfg.retrain_min_new, F.concat(F.lit("new_transactions="), "new_transactions", F.lit(f" >= {cfg.retrain_min_new}"))),
        F.when(F.col("age_days") >= cfg.retrain_max_age_days, F.concat(F.lit("age_days="), "age_days", F.lit(f" >= {cfg.retrain_max_age_days}"))),
        F.when(F.col("amount_psi") >= cfg.psi_threshold, F.concat(F.lit("amount_drift_psi="), F.format_string("%.3f", "amount_psi"), F.lit(f" >= {cfg.psi_threshold:g}")))))
    return out.select("new_transactions", "age_days", "amount_psi", reasons.alias("reasons"), (F.size(reasons) > 0).alias("should_retrain"))


def changed_alerts(signatures: DataFrame, key: str = "alert_key", tie: tuple[str, ...] = ("id",)) -> DataFrame:
    """Only the observations whose signature differs from the key's previous one."""
    seen = previous_value(signatures, F.col("signature"), "previous", key, "ts", tie)
    return seen.where(F.col("previous").isNull() | (F.col("previous") != F.col("signature")))


def link_feedback(verdicts: DataFrame, decisions: DataFrame, existing: DataFrame, tie: tuple[str, ...] = ()) -> DataFrame:
    """The feedback table after new verdicts: linked to the latest decision, unknown transactions kept, latest wins.

    A null link never replaces a stored one. Of verdicts of one time the first by `tie` counts, or else the last by name.
    """
    known = verdicts.withColumn("verdict", canonical_verdict("verdict")).where("verdict IS NOT NULL")
    newest = first_per_key(known, ["transaction_id"], [F.desc("created_at"), *[F.asc(c) for c in tie], F.desc("verdict")]).drop(*tie)
    linked = newest.join(latest_decisions(decisions).select("transaction_id", "entity_key", "decision"), "transaction_id", "left")
    old = existing.select("transaction_id", F.col("entity_key").alias("_e"), F.col("decision").alias("_d"), F.col("verdict").alias("_v"))
    return linked.join(old, "transaction_id", "full_outer").select(
        "transaction_id", F.coalesce("entity_key", "_e").alias("entity_key"), F.coalesce("decision", "_d").alias("decision"),
        F.coalesce("verdict", "_v").alias("verdict"), (F.col("_v").isNotNull() & F.col("verdict").isNotNull()).alias("was_update"))


def run_summary(results: DataFrame) -> DataFrame:
    """One row per decision and per activity code with its count."""
    pairs = F.array(
        F.struct(F.lit("decision").alias("what"), F.col("decision").alias("value")),
        F.struct(F.lit("code").alias("what"), F.col("activity_code").alias("value")))
    return results.select(F.inline(pairs)).groupBy("what", "value").agg(F.count("*").alias("n"))


def latency_summary(results: DataFrame, col: str = "latency_ms") -> DataFrame:
    """Average, interpolated median and 95th percentile, and maximum latency."""
    one = F.lit(1).alias("_one")
    base = results.agg(F.count("*").alias("requests"), F.avg(col).alias("avg_ms"), F.max(col).alias("max_ms")).select("*", one)
    q = quantiles(results, col, {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}).select("*", one)
    return base.join(q, "_one").drop("_one")


def sla_report(requests: DataFrame, sla_ms: float = 600.0) -> DataFrame:
    """Breaches among successful requests, and latency percentiles."""
    one = F.lit(1).alias("_one")
    ok = F.col("ok")
    counts = requests.agg(
        F.count("*").alias("total"), F.count_if(~ok).alias("failures"), F.count_if(ok & (F.col("latency_ms") > sla_ms)).alias("sla_breaches"),
        F.round(100.0 * F.count_if(ok & (F.col("latency_ms") > sla_ms)) / F.greatest(F.count_if(ok), F.lit(1)), 2).alias("breach_pct")).select("*", one)
    out = counts.join(latency_summary(requests).drop("requests").select("*", one), "_one").drop("_one")
    return out.withColumn("sla_met_at_p95", F.col("p95_ms") <= sla_ms)


def geo_sources(log: DataFrame) -> DataFrame:
    """Where eligible traffic's coordinates came from, and why the rest had none."""
    rows = eligible_log(log)
    return rows.groupBy(F.coalesce("geo.geo_source", F.lit("unavailable")).alias("geo_source"), F.col("geo.unresolved_reason").alias("reason")).agg(F.count("*").alias("n"))


def eligible_log(log: DataFrame) -> DataFrame:
    """Records of established customers; records without the flag fall back to the cold-start one."""
    established = F.coalesce(F.col("geo.geo_eligible"), ~F.col("is_cold_start"), F.lit(False))
    return log.where((F.col("event") == "inference") & F.col("geo").isNotNull() & established)


def index_quantile(df: DataFrame, col: str, qs: dict[str, float]) -> DataFrame:
    """Quantiles by position min(n - 1, floor(p * n)) of the sorted values: no interpolation."""
    from habitus.operators.ordered import running_sums

    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("_x")).agg(F.count("*").alias("n"))
    ranked = running_sums(counts, "_x", ["n"])

    def holds(p: float) -> Column:
        pos = F.least(F.col("n_total") - 1, F.floor(F.col("n_total") * p))
        return (F.col("n_before") <= pos) & (pos < F.col("n_before") + F.col("n"))

    return ranked.agg(*[F.max(F.when(holds(p), F.col("_x"))).alias(name) for name, p in qs.items()])


def geo_velocity_report(log: DataFrame, high_kmh: float = 900.0) -> DataFrame:
    """Distribution of geo velocity, and how high speeds fall on the model's decisions."""
    rows = eligible_log(log).where((F.col("geo.geo_velocity_available") == 1) & F.col("geo.geo_velocity_kmh").isNotNull())
    rows = rows.select("status", F.col("geo.geo_velocity_kmh").alias("kmh"))
    high = F.col("kmh") >= high_kmh
    one = F.lit(1).alias("_one")
    counts = rows.agg(
        F.count("*").alias("calculable"), F.count_if(F.col("kmh") > 0).alias("nonzero"), F.min("kmh").alias("min_kmh"), F.max("kmh").alias("max_kmh"),
        F.count_if(high).alias("high"), *[F.count_if(high & (F.col("status") == s)).alias(f"high_{s}") for s in ("safe", "review", "unsafe")]).select("*", one)
    median = quantiles(rows, "kmh", {"median_kmh": 0.5}).select("*", one)
    tail = index_quantile(rows, "kmh", {"p90_kmh": 0.9, "p95_kmh": 0.95}).select("*", one)
    return counts.join(median, "_one").join(tail, "_one").drop("_one")


def geo_precision(log: DataFrame) -> DataFrame:
    """Precision per source: how many, median and worst, in metres."""
    rows = eligible_log(log).select(F.col("geo.geo_source").alias("geo_source"), F.col("geo.geo_precision_m").alias("metres")).where("metres IS NOT NULL AND geo_source IS NOT NULL")
    stats = rows.groupBy("geo_source").agg(F.count("*").alias("n"), F.max("metres").alias("max_m"))
    return stats.join(quantiles(rows, "metres", {"median_m": 0.5}, ("geo_source",)), "geo_source")


def plus_code_sample(cache: DataFrame, eligible: DataFrame, least: int = 2, top: int | None = None) -> DataFrame:
    """Eligible customers whose locations carry a code, most first; a report may ask for the first `top`."""
    coded = cache.where(F.col("customer_location").contains("+")).join(eligible.select("customer_key"), "customer_key", "left_semi")
    out = coded.groupBy("customer_key").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.col("n").desc(), "customer_key")
    return out if top is None else out.limit(top)
