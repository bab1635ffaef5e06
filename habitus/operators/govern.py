"""Governance: trust gate, settings, retrain counters and triggers, rollback, versions and the model registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from habitus.config import DEFAULTS, Settings
from habitus.functions.normalize import days_between
from habitus.operators.filters import latest, strict_clean
from habitus.sources.ingest import window_start


def trust_gate(profiles: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Whether each profile may be judged on its own history now, and the first reason why not."""
    def num(c: str) -> Column:
        return F.coalesce(c, F.lit(0))

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("None"))

    reason = (
        F.when(F.coalesce(F.col("profile_status") != "active", F.lit(True)), F.concat(F.lit("peer_baseline ("), text("profile_status"), F.lit(")")))
        .when(num("confidence_score") < cfg.trust_confidence, F.concat(F.lit("peer_baseline (low confidence "), text("confidence_score"), F.lit(")")))
        .when(num("suspicious_tx_count") > cfg.max_fraud_txns, F.concat(F.lit("peer_baseline (§1 confirmed fraud: "), text("suspicious_tx_count"), F.lit(" txn(s))")))
        .when(num("tenure_days") < cfg.min_tenure_days, F.concat(F.lit("peer_baseline (§1 tenure "), text("tenure_days"), F.lit(f"d < {cfg.min_tenure_days}d)")))
        .when(num("lifetime_clean_txns") < cfg.min_clean_txns, F.concat(F.lit("peer_baseline (§1 clean txns "), text("lifetime_clean_txns"), F.lit(f" < {cfg.min_clean_txns})")))
        .otherwise("own_profile"))
    return profiles.withColumn("trust_reason", reason).withColumn("trusted", F.col("trust_reason") == "own_profile")


def effective_settings(defaults: DataFrame, overrides: DataFrame, branches: DataFrame) -> DataFrame:
    """Every branch's rules: its own switch and parameters over the defaults, parameter by parameter.

    Rules are a short list carried as one array, so each branch is expanded in place.
    """
    rules = defaults.agg(F.collect_list(F.struct("rule_code", "params", "enabled"))).scalar()
    every = branches.withColumn("_r", rules).select("branch_id", F.inline("_r"))
    own = overrides.select("branch_id", "rule_code", F.col("params").alias("_p"), F.col("enabled").alias("_e"))
    empty = F.create_map().cast("map<string,string>")
    return every.join(own, ["branch_id", "rule_code"], "left").select(
        "branch_id", "rule_code", F.coalesce("_e", "enabled").alias("enabled"),
        F.map_zip_with(F.coalesce("params", empty), F.coalesce("_p", empty), lambda k, a, b: F.coalesce(b, a)).alias("params"))


def retrain_counters(profiles: DataFrame) -> DataFrame:
    """Per entity over its currencies: most new transactions, most drift signals, the oldest build."""
    return profiles.groupBy("entity_key").agg(
        F.max("txns_since_build").alias("new_txns"), F.max("drift_signal_count").alias("drift_signals"),
        F.min("last_retrained_at").alias("oldest"), F.count("*").alias("profiles"))


def retrain_due(counters: DataFrame, as_of: Column, cfg: Settings = DEFAULTS) -> DataFrame:
    """Which trigger makes a rebuild due, the first that applies, and how far each one still is."""
    days = F.floor(days_between(as_of, "oldest"))
    met = {
        "new_transactions": F.col("new_txns") >= cfg.retrain_min_new, "days_since_build": days >= cfg.retrain_max_age_days,
        "drift_signals": F.col("drift_signals") >= cfg.drift_signals}
    trigger = F.coalesce(*[F.when(c, F.lit(n)) for n, c in met.items()])

    def to_go(limit: int, have: Column) -> Column:
        return F.greatest(F.lit(limit) - F.coalesce(have, F.lit(0)), F.lit(0))

    return counters.withColumns({
        "days_since_build": days, "trigger": trigger, "txns_to_go": to_go(cfg.retrain_min_new, F.col("new_txns")),
        "days_to_go": to_go(cfg.retrain_max_age_days, days), "signals_to_go": to_go(cfg.drift_signals, F.col("drift_signals")),
    }).withColumn("due", F.col("trigger").isNotNull())


def rebuild_worklist(txn: DataFrame, as_of: Column, min_rows: int = 1, months: int = 3) -> DataFrame:
    """Entities with enough rows in the window, busiest first."""
    return txn.where(F.col("ts") >= window_start(as_of, months)).groupBy("entity_key").agg(F.count("*").alias("n")).where(
        F.col("n") >= min_rows).orderBy(F.col("n").desc(), "entity_key")


def diagnose_empty(cache: DataFrame, keys: DataFrame, as_of: Column, months: int = 3) -> DataFrame:
    """Why an entity has nothing to learn from: no data at all, none of its own in the window, or only excluded rows."""
    recent = cache.where(F.col("ts") >= window_start(as_of, months))
    mine = recent.groupBy("entity_key").agg(F.count("*").alias("rows_in_window"))
    clean = strict_clean(recent).groupBy("entity_key").agg(F.count("*").alias("_clean"))
    total = cache.agg(F.count("*")).scalar()
    out = keys.join(mine, "entity_key", "left").join(clean, "entity_key", "left").withColumn("rows_in_window", F.coalesce("rows_in_window", F.lit(0)))
    reason = (
        F.when(total == 0, "cache_not_populated").when(F.col("rows_in_window") == 0, "customer_not_in_cache")
        .when(F.col("_clean").isNull(), "all_cached_txns_excluded").otherwise("has_clean_history"))
    return out.withColumn("reason", reason).withColumn("about_this_customer", F.col("reason") == "all_cached_txns_excluded").drop("_clean")


def rollback(profiles: DataFrame, history: DataFrame, which: Column, cols: list[str], keys: tuple[str, ...] = ("entity_key",)) -> DataFrame:
    """Restore columns of a chosen snapshot (the newest one that matches); other profiles stay as they are."""
    snap = latest(history.where(which), list(keys), ("snapshot_ts", "profile_version"))
    snap = snap.select(*keys, *[F.col(c).alias(f"_h_{c}") for c in (*cols, "profile_version")])
    restored = F.col("_h_profile_version").isNotNull()
    return profiles.join(snap, list(keys), "left").withColumns(
        {c: F.when(restored, F.col(f"_h_{c}")).otherwise(F.col(c)) for c in (*cols, "profile_version")}
        | {"retrain_reason": F.when(restored, "rolled_back").otherwise(F.col("retrain_reason"))},
    ).drop(*[f"_h_{c}" for c in (*cols, "profile_version")])


def restore(
    profiles: DataFrame, history: DataFrame, which: Column, schemas: dict[int, str], scalars: tuple[str, ...], keys: tuple[str, ...] = ("entity_key",),
) -> DataFrame:
    """Restore profiles from the newest matching snapshot, as whole as it was stored; adds `restored`: full, scalars or null.

    `history` has profile_json with schema_version, whose columns `schemas` names per version (DDL); columns that a version did
    not have yet keep their present values. A snapshot without the document, with a broken one or of an unknown version gives its
    scalars alone, and the profile says `rolled_back`. Other profiles stay as they are.
    """
    snap = latest(history.where(which), list(keys), ("snapshot_ts", "profile_version"))
    documents = {v: F.from_json("profile_json", ddl) for v, ddl in schemas.items()}
    broken = F.lit(False)
    for v in schemas:  # a broken document has none of its keys
        broken = F.when(F.col("schema_version") == v, F.col(f"_d{v}.{keys[0]}").isNull()).otherwise(broken)
    usable = F.col("schema_version").isin(list(schemas)) & F.col("profile_json").isNotNull() & ~broken
    snap = snap.withColumns({f"_d{v}": d for v, d in documents.items()})
    snap = snap.select(*keys, F.when(usable, "full").otherwise("scalars").alias("restored"), F.col("schema_version").alias("_v"), *[f"_d{v}" for v in schemas],
                       *[F.col(c).alias(f"_s_{c}") for c in (*scalars, "profile_version")])
    fields = {v: set(snap.schema[f"_d{v}"].dataType.fieldNames()) for v in schemas}
    joined = profiles.join(snap, list(keys), "left")

    def value(c: str) -> Column:
        out = F.col(c)
        for v in schemas:
            if c in fields[v]:
                out = F.when((F.col("restored") == "full") & (F.col("_v") == v), F.col(f"_d{v}.{c}")).otherwise(out)
        return F.when(F.col("restored") == "scalars", F.col(f"_s_{c}")).otherwise(out) if c in scalars else out

    columns = {c: value(c) for c in profiles.columns if c not in (*keys, "profile_version", "retrain_reason")}
    columns["profile_version"] = F.coalesce("_s_profile_version", "profile_version")
    columns["retrain_reason"] = F.when(F.col("restored") == "scalars", "rolled_back").otherwise(F.col("retrain_reason"))
    return joined.withColumns(columns).select(*profiles.columns, "restored")


def versions(history: DataFrame, key: str = "entity_key") -> DataFrame:
    """Snapshots of every entity in order of time."""
    w = Window.partitionBy(key).orderBy("snapshot_ts", "profile_version")
    return history.withColumn("seq", F.row_number().over(w))


def promotion_history(manifests: DataFrame) -> DataFrame:
    """Replay the promotion gate over the registry (one row per trained model): a candidate must not be worse than the
    best model so far, by synthetic AUC, or by weak-label F1 when it has none."""
    metric = F.coalesce("synthetic_auc", "f1", F.lit(0.0))
    w = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifests.withColumn("active_auc", F.max(metric).over(w)).withColumn("promoted", metric >= F.coalesce("active_auc", F.lit(0.0)))


def promotion_gate(candidate: DataFrame, active: DataFrame) -> DataFrame:
    """Decide one candidate against the active model; either table has at most one row."""
    c = candidate.select(F.col("version"), F.col("synthetic_auc").alias("_ca"), F.col("f1").alias("_cf"), F.lit(1).alias("_one"))
    a = active.select(F.col("synthetic_auc").alias("_aa"), F.col("f1").alias("_af"), F.lit(1).alias("_one"))
    zero = F.lit(0.0)
    ok = F.when(F.col("_ca").isNotNull(), F.col("_ca") >= F.coalesce("_aa", zero)).otherwise(F.coalesce("_cf", zero) >= F.coalesce("_af", zero))
    return c.join(a, "_one", "left").select("version", F.coalesce(ok, F.lit(False)).alias("promote"))


def promote(registry: DataFrame, version: str) -> DataFrame:
    """Make one version active; the active one becomes previous, and the previous one retires."""
    state = (
        F.when(F.col("version") == version, "active").when(F.col("status") == "active", "previous")
        .when(F.col("status") == "previous", "retired").otherwise(F.col("status")))
    return registry.withColumn("status", state)


def rollback_model(registry: DataFrame) -> DataFrame:
    """Swap the active and the previous version; nothing changes while there is no previous one."""
    has_previous = registry.agg(F.bool_or(F.col("status") == "previous")).scalar()
    swapped = F.when(F.col("status") == "active", "previous").when(F.col("status") == "previous", "active").otherwise(F.col("status"))
    return registry.withColumn("status", F.when(has_previous, swapped).otherwise(F.col("status")))


def health(manifests: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Problems of each model against the acceptance floors."""
    def low(c: str, label: str, floor: float) -> Column:
        return F.when(F.col(c) < floor, F.concat(F.lit(f"{label} "), F.format_string("%.3f", c), F.lit(f" < floor {floor:g}")))

    problems = F.array_compact(F.array(
        low("synthetic_auc", "synthetic-anomaly AUC", cfg.min_synthetic_auc), low("precision", "precision", cfg.min_precision)))
    return manifests.withColumn("problems", problems).withColumn("healthy", F.size("problems") == 0)


def performance_history(manifests: DataFrame) -> DataFrame:
    """Model quality over time: change against the model before and the mean of the last five (a row per trained model)."""
    w = Window.orderBy("seq")
    return manifests.withColumns({
        "auc_change": F.col("synthetic_auc") - F.lag("synthetic_auc").over(w),
        "auc_trend": F.avg("synthetic_auc").over(w.rowsBetween(-4, 0))})


def schema_state(stored: Column, running: list[str]) -> Column:
    """How a stored feature list relates to the running one: equal, prefix or mismatch."""
    now = F.array(*[F.lit(f) for f in running])
    return F.when(stored == now, "equal").when(stored == F.slice(now, 1, F.size(stored)), "prefix").otherwise("mismatch")
