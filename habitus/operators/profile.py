"""Behaviour profiles: numeric core, categorical maps, histograms, cadence, governance fields and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from habitus.config import DEFAULTS, Settings, WEEKDAYS_SHORT
from habitus.functions.normalize import city_of, days_between, decay_weight, exact_sum, ip_subnet_loose, is_night, iso_weekday
from habitus.operators.filters import confirmed_fraud
from habitus.operators.ordered import by_size, quantiles
from habitus.operators.salted import salted_join

ROW_ORDER = ("ts", "id", "version", "amount")

# kind -> (source column, values seen less often are left out of the map)
KINDS = {
    "transaction_type": ("transaction_type", 1),
    "merchant": ("merchant_name", 2),
    "location": ("customer_location", 2),
    "city": ("city", 2),
    "country": ("origin_country", 2),
    "ip": ("customer_ip_address", 1),
    "subnet": ("ip_subnet", 1),
    "beneficiary": ("destination_account_no", 1),
}
MAP_NAMES = {
    "transaction_type": "usual_transaction_types", "merchant": "usual_merchants", "location": "usual_locations",
    "city": "usual_cities", "country": "usual_countries", "ip": "known_ip_addresses", "subnet": "known_ip_subnets",
    "beneficiary": "beneficiaries",
}
COMPLETE = ("city", "country", "subnet", "beneficiary")  # kinds whose maps, with the hours, make a profile complete
ENTROPY_NAMES = {"transaction_type": "transaction_type_entropy", "merchant": "merchant_entropy", "city": "location_entropy"}


def prepared(clean: DataFrame) -> DataFrame:
    """Derived columns that profile aggregates read, of the columns that are there."""
    derived = {"city": ("customer_location", city_of), "ip_subnet": ("customer_ip_address", ip_subnet_loose)}
    return clean.withColumns({n: of(c) for n, (c, of) in derived.items() if c in clean.columns})


def newest(df: DataFrame) -> Column:
    """The newest time in the table, as a scalar subquery: the reference point of all ages."""
    return df.agg(F.max("ts")).scalar()


def order_key() -> Column:
    return F.struct(*[F.col(c) for c in ROW_ORDER])


def core_columns(as_of: Column, cfg: Settings = DEFAULTS) -> dict[str, Column]:
    """The numeric core, one aggregate expression per output column; all share a single pass over the rows."""
    age = days_between(as_of, "ts")
    amount, w = F.col("amount"), decay_weight(age, cfg.half_life_days)
    recent = age <= 30

    def since(days: int) -> Column:
        return F.count_if(age <= days)

    first = {c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order_key()))
             for c in ("customer_name", "identifier", "bvn", "account_type")}
    last = F.max_by(F.struct("customer_location", "city", "origin_country", "customer_ip_address"), order_key())
    return first | {
        "first_seen": F.min("ts"), "last_seen": F.max("ts"), "total_tx_count": F.count("*"),
        "total_tx_amount": exact_sum("amount"), "avg_amount": exact_sum("amount") / F.count("*"),
        "min_amount": F.min(amount), "max_amount": F.max(amount), "std_amount": F.stddev_samp(amount),
        "tx_count_24h": since(1), "tx_count_7d": since(7), "tx_count_30d": since(30),
        "tx_count_60d": since(60), "tx_count_90d": since(90),
        "amt_sum_30d": exact_sum(F.when(recent, amount)), "amt_sum_90d": exact_sum(F.when(age <= 90, amount)),
        "avg_amount_30d": F.try_divide(exact_sum(F.when(recent, amount)), F.count_if(recent)),
        "max_amount_30d": F.max(F.when(recent, amount)), "std_amount_30d": F.stddev_samp(F.when(recent, amount)),
        "decayed_tx_count": F.sum(w), "decayed_avg_amount": F.sum(w * amount) / F.sum(w),
        "ewma_var_amount": F.sum(w * amount * amount) / F.sum(w) - F.pow(F.sum(w * amount) / F.sum(w), F.lit(2.0)),
        "night_activity_ratio": F.avg(is_night("ts").cast("int")),
        "suspicious_count": F.count_if(F.col("status") == "suspicious"),
        "suspicious_share": F.avg((F.col("status") == "suspicious").cast("int")),
        "is_blacklisted": F.coalesce(F.bool_or("sender_blacklisted"), F.lit(False)),
        "last_event": last,
        "null_beneficiary": F.max(F.col("destination_account_no").isNull().cast("int")),
        "null_beneficiary_30d": F.max((F.col("destination_account_no").isNull() & recent).cast("int")),
        "null_beneficiary_24h": F.max((F.col("destination_account_no").isNull() & (age <= 1)).cast("int")),
    }


def core(clean: DataFrame, as_of: Column, keys: tuple[str, ...], names: list[str], cfg: Settings = DEFAULTS) -> DataFrame:
    """Some or all core columns per key."""
    cols = core_columns(as_of, cfg)
    return prepared(clean).groupBy(*keys).agg(*[cols[n].alias(n) for n in names])


def value_counts(clean: DataFrame, keys: tuple[str, ...], kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """(keys, kind, value) with its count and newest time.

    All categorical columns are stacked and counted in one shuffle; counting starts before the shuffle, so what
    travels is at most one row per distinct value and task.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(KINDS[k][0]).cast("string").alias("value")) for k in kinds])
    return (
        prepared(clean).select(*keys, "ts", F.explode(pairs).alias("p")).where("p.value <> ''")
        .groupBy(*keys, F.col("p.kind").alias("kind"), F.col("p.value").alias("value"))
        .agg(F.count("*").alias("n"), F.max("ts").alias("last_ts")))


def least_count(cfg: Settings) -> Column:
    stable = [k for k, (_, m) in KINDS.items() if m > 1]
    return F.when(F.col("kind").isin(*stable), cfg.min_pattern_obs).otherwise(1)


def top_values(counts: DataFrame, keys: tuple[str, ...], cfg: Settings = DEFAULTS) -> DataFrame:
    """The most frequent values per key and kind; ties go to the smaller value.

    The rank filter is pushed below the shuffle, so each task forwards at most `top_n` rows per key and kind.
    """
    w = Window.partitionBy(*keys, "kind").orderBy(F.col("n").desc(), "value")
    return counts.where(F.col("n") >= least_count(cfg)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cfg.top_n)


def top_maps(counts: DataFrame, keys: tuple[str, ...], kinds: tuple[str, ...] = tuple(KINDS), cfg: Settings = DEFAULTS) -> DataFrame:
    """One map column {value: count} per kind; at most `top_n` entries each."""
    def as_map(kind: str) -> Column:
        entry = F.when(F.col("kind") == kind, F.struct("value", "n"))
        return F.map_from_entries(F.array_sort(F.collect_list(entry)))

    return top_values(counts, keys, cfg).groupBy(*keys).agg(*[as_map(k).alias(MAP_NAMES[k]) for k in kinds])


def entropy_of(n: Column, share: Column) -> Column:
    """Shannon entropy in nats from a total N and the sum of c * ln c over the counts: ln N - sum / N."""
    return F.coalesce(F.greatest(F.ln(n) - F.try_divide(share, n), F.lit(0.0)), F.lit(0.0))


def entropies(counts: DataFrame, keys: tuple[str, ...], kinds: tuple[str, ...] = tuple(ENTROPY_NAMES)) -> DataFrame:
    """Entropy per kind; a kind without values has none (0)."""
    def one(kind: str) -> Column:
        mine = F.col("kind") == kind
        n = F.sum(F.when(mine, F.col("n")))
        return entropy_of(n, F.sum(F.when(mine, F.col("n") * F.ln("n"))))

    return counts.groupBy(*keys).agg(*[one(k).alias(ENTROPY_NAMES[k]) for k in kinds])


def categories(clean: DataFrame, keys: tuple[str, ...], kinds: tuple[str, ...] = tuple(KINDS), cfg: Settings = DEFAULTS) -> DataFrame:
    """Top maps and entropies of the kinds named. Stored rows of a key with few of them move once, by the key; those of the others are
    counted by value first, as everywhere."""
    def both(rows: DataFrame) -> DataFrame:
        counts = value_counts(rows, keys, kinds)
        measured = tuple(k for k in kinds if k in ENTROPY_NAMES)
        maps = top_maps(counts, keys, kinds, cfg)
        return maps.join(entropies(counts, keys, measured), list(keys), "full") if measured else maps

    return by_size(clean, keys, lambda rows: both(rows.repartition(*keys)), both)


def distinct_beneficiaries(clean: DataFrame, as_of: Column, keys: tuple[str, ...]) -> DataFrame:
    """Distinct beneficiaries overall, in 30 days and in 24 hours; an unknown beneficiary counts as one value."""
    per_value = clean.groupBy(*keys, "destination_account_no").agg(F.max("ts").alias("last_ts"))
    age = days_between(as_of, "last_ts")
    return per_value.groupBy(*keys).agg(
        F.count("*").alias("distinct_beneficiaries"), F.count_if(age <= 30).alias("distinct_beneficiaries_30d"),
        F.count_if(age <= 1).alias("distinct_beneficiaries_24h"))


def histogram(clean: DataFrame, keys: tuple[str, ...], part: str = "hour") -> DataFrame:
    """Map of counts per hour of day or weekday, and the busiest bucket (the earliest on ties)."""
    if part == "hour":
        bucket, label, names = F.hour("ts"), F.col("bucket").cast("string"), ("peak_transaction_hours", "top_hour")
    else:
        bucket = iso_weekday("ts")
        label = F.get(F.array(*[F.lit(x) for x in WEEKDAYS_SHORT]), F.col("bucket") - 1)
        names = ("peak_transaction_days", "top_day_of_week")
    top = F.max_by(F.col("bucket") if part == "hour" else label, F.struct(F.col("n"), -F.col("bucket")))
    return clean.groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("n")).groupBy(*keys).agg(
        F.map_from_entries(F.transform(
            F.array_sort(F.collect_list(F.struct("bucket", label.alias("label"), "n"))),
            lambda e: F.struct(e["label"], e["n"]))).alias(names[0]),
        top.alias(names[1]))


def months_spanned(clean: DataFrame) -> Column:
    """Length of the learning window in 30-day months, at least one day."""
    span = F.expr("(unix_micros(max(ts)) - unix_micros(min(ts))) div 86400000000")
    return clean.agg((F.greatest(span, F.lit(1)) / 30.0).alias("m")).scalar()


def with_cadence(profile: DataFrame, as_of: Column, months: Column) -> DataFrame:
    """Monthly rates, age and dormancy."""
    return profile.withColumns({
        "avg_monthly_tx_count": F.col("total_tx_count") / months,
        "avg_monthly_amount": F.col("total_tx_amount") / months,
        "age_days": days_between(as_of, "first_seen"), "dormant_days": days_between(as_of, "last_seen"),
    })


def with_prev_seen(txn: DataFrame, prev: DataFrame) -> DataFrame:
    """Add the previous build's last_seen to every transaction (null for new entities)."""
    return salted_join(txn, prev.select("entity_key", F.col("last_seen").alias("prev_last_seen")), "entity_key")


def new_txn_counts(clean: DataFrame, prev: DataFrame, keys: tuple[str, ...] = ("entity_key",)) -> DataFrame:
    """Transactions newer than the previous build; none for entities without one.

    Rows are counted by time first, so a busy entity's rows of one moment are one; entities with many moments are split.
    """
    newer = F.coalesce(F.col("ts") > F.col("prev_last_seen"), F.lit(False))
    moments = clean.groupBy(*dict.fromkeys((*keys, "entity_key", "ts"))).agg(F.count("*").alias("_rows"))
    return with_prev_seen(moments, prev).groupBy(*keys).agg(F.coalesce(F.sum(F.when(newer, F.col("_rows"))), F.lit(0)).alias("new_txns"))


def fraud_counts(unique_rows: DataFrame, key: str = "entity_key") -> DataFrame:
    """Confirmed-fraud rows per entity, counted before the clean filter removes them."""
    return unique_rows.where(confirmed_fraud()).groupBy(key).agg(F.count("*").alias("fraud_txns"))


def suspicious_ratio(fraud: Column, clean: Column) -> Column:
    return F.coalesce(F.try_divide(fraud, fraud + clean), F.lit(0.0))


def tenure(txn: DataFrame) -> DataFrame:
    """Lifetime totals per account."""
    return txn.groupBy("branch_id", "origin_account_no").agg(
        F.min("ts").alias("first_seen_ever"), F.max("ts").alias("last_seen_ever"), F.count("*").alias("lifetime_txns"),
        F.count_if(F.col("status") == "clean").alias("lifetime_clean_txns"),
        F.count_if(F.col("status") == "suspicious").alias("lifetime_suspicious"),
        F.count_if("is_blocked").alias("lifetime_blocked"))


def carry_tenure(span: DataFrame, prev: DataFrame, as_of: Column) -> DataFrame:
    """Account age and lifetime clean count per entity.

    With a stored tenure, age grows by the whole days since the last build and the clean count is carried as it is;
    without one, both are what the window can prove. `span` has (entity_key, first_seen, rows).
    """
    old = prev.groupBy("entity_key").agg(
        F.max("tenure_days").alias("_days"), F.max("lifetime_clean_txns").alias("_clean"),
        F.max("last_retrained_at").alias("_built"))
    days = F.floor(days_between(as_of, "first_seen"))
    grown = F.greatest(F.floor(days_between(as_of, "_built")), F.lit(0))
    known = F.coalesce(F.col("_days"), F.lit(0)) > 0
    return span.join(old, "entity_key", "left").select(
        "entity_key",
        F.when(known, F.col("_days") + F.coalesce(grown, F.lit(0))).otherwise(days).alias("tenure_days"),
        F.when(known, F.coalesce(F.nullif(F.col("_clean"), F.lit(0)), F.col("rows"))).otherwise(F.col("rows")).alias("lifetime_clean_txns"))


def confidence(days: Column, txns: Column, avg: Column, std: Column, present: Column, cfg: Settings = DEFAULTS) -> Column:
    """0-100: half history, 30 % steadiness of amounts, 20 % completeness; halves round to even."""
    one, zero = F.lit(1.0), F.lit(0.0)
    history = 0.5 * (
        F.least(one, F.coalesce(days, F.lit(0)) / max(cfg.min_tenure_days, 1))
        + F.least(one, F.coalesce(txns, F.lit(0)) / max(cfg.min_clean_txns, 1)))
    mean, spread = F.coalesce(avg, zero), F.coalesce(std, zero)
    variation = F.when(mean > 0, spread / (mean + 1.0)).otherwise(5.0)
    score = 100.0 * (0.5 * history + 0.3 * (1.0 / (1.0 + variation)) + 0.2 * (present / 5.0))
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(score).cast("int")))


def eligibility_status(days: Column, txns: Column, fraud: Column, cfg: Settings = DEFAULTS) -> Column:
    """Active needs enough tenure, enough clean transactions and no more confirmed fraud than allowed."""
    ok = (days >= cfg.min_tenure_days) & (txns >= cfg.min_clean_txns) & (fraud <= cfg.max_fraud_txns)
    return F.when(ok, "active").otherwise("warming_up")


ATTRIBUTES = ("customer_name", "identifier", "bvn", "account_type", "last_event")


def build_profiles(
    clean: DataFrame, unique_rows: DataFrame, as_of: Column, keys: tuple[str, ...] = ("entity_key",),
    tenure_by_entity: DataFrame | None = None, cfg: Settings = DEFAULTS, kinds: tuple[str, ...] = tuple(KINDS), attributes: bool = True,
) -> DataFrame:
    """The full profile per key, of stored rows; with only some `kinds` of maps and no `attributes` for those who read no others.

    Every part is an aggregate that ends hash-partitioned by the key, so the final joins reuse those partitions. The confidence needs
    the maps of COMPLETE and is left out without them.
    """
    left_out = ("null_", "suspicious_") if attributes else ("null_", "suspicious_", *ATTRIBUTES)
    columns = [n for n in core_columns(as_of, cfg) if not n.startswith(left_out)]
    base = core(clean, as_of, (*keys, "branch_id", "origin_account_no") if attributes and "entity_key" in keys else keys, columns, cfg)
    parts = [
        quantiles(clean, "amount", {"median_amount": 0.5, "p95_amount": 0.95}, keys, stored=True),
        distinct_beneficiaries(clean, as_of, keys), categories(clean, keys, kinds, cfg),
        histogram(clean, keys, "hour"), histogram(clean, keys, "weekday"),
    ]
    out = with_cadence(base, as_of, months_spanned(clean))
    for part in parts:
        out = out.join(part, list(keys), "left")
    out = out.join(fraud_counts(unique_rows), "entity_key", "left").withColumn("fraud_txns", F.coalesce("fraud_txns", F.lit(0)))
    out = out.withColumns({m: F.coalesce(m, F.create_map().cast("map<string,bigint>")) for m in (MAP_NAMES[k] for k in kinds)})
    if tenure_by_entity is not None:
        out = out.join(tenure_by_entity, "entity_key", "left")
    else:
        out = out.withColumns({"tenure_days": F.lit(None).cast("long"), "lifetime_clean_txns": F.lit(None).cast("long")})
    days = F.coalesce("tenure_days", F.floor("age_days"))
    txns = F.coalesce("lifetime_clean_txns", "total_tx_count")
    out = out.withColumns({
        "tenure_days": days, "lifetime_clean_txns": txns, "suspicious_tx_count": F.col("fraud_txns"),
        "suspicious_ratio": suspicious_ratio(F.col("fraud_txns"), F.col("total_tx_count")),
        "profile_status": eligibility_status(days, txns, F.col("fraud_txns"), cfg),
    })
    if set(COMPLETE) <= set(kinds):
        present = sum(((F.size(m) > 0).cast("int") for m in (*(MAP_NAMES[k] for k in COMPLETE), "peak_transaction_hours")), F.lit(0))
        out = out.withColumn("confidence_score", confidence(F.col("tenure_days"), F.col("lifetime_clean_txns"), F.col("avg_amount"), F.col("std_amount"), present, cfg))
    if attributes:
        out = out.withColumns({
            "last_location": F.col("last_event.customer_location"), "last_city": F.col("last_event.city"),
            "last_country": F.col("last_event.origin_country"), "last_ip": F.col("last_event.customer_ip_address"),
        }).drop("last_event")
    return out.drop("fraud_txns")


def confidences(clean: DataFrame, as_of: Column, keys: tuple[str, ...] = ("entity_key",), cfg: Settings = DEFAULTS) -> DataFrame:
    """The confidence that the full profile has, without its maps: of each it only asks whether there is an entry. Values of a kind that
    needs no second sight are not counted at all."""
    base_names = ("first_seen", "total_tx_count", "avg_amount", "std_amount")
    cols = core_columns(as_of, cfg)
    once = tuple(k for k in COMPLETE if KINDS[k][1] == 1)
    often = tuple(k for k in COMPLETE if k not in once)
    seen = {k: F.coalesce(F.bool_or(F.col(KINDS[k][0]) != ""), F.lit(False)).alias(f"_has_{k}") for k in once}
    base = prepared(clean).groupBy(*keys).agg(*[cols[n].alias(n) for n in base_names], *seen.values())
    kept = value_counts(clean, keys, often).where(F.col("n") >= least_count(cfg)).groupBy(*keys).agg(*[F.bool_or(F.col("kind") == k).alias(f"_has_{k}") for k in often])
    out = base.join(kept, list(keys), "left")
    present = sum((F.coalesce(F.col(f"_has_{k}"), F.lit(False)).cast("int") for k in COMPLETE), F.lit(1))  # every row has an hour
    days = F.floor(days_between(as_of, "first_seen"))
    return out.select(*keys, confidence(days, F.col("total_tx_count"), F.col("avg_amount"), F.col("std_amount"), present, cfg).alias("confidence_score"))


def dominant(profiles: DataFrame, key: str = "entity_key", by: str = "total_tx_count", tie: str = "currency") -> DataFrame:
    """The row with most transactions per entity."""
    w = Window.partitionBy(key).orderBy(F.col(by).desc(), tie)
    return profiles.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def bump_version(new: DataFrame, prev: DataFrame, keys: tuple[str, ...] = ("entity_key",)) -> DataFrame:
    """Next version number of every rebuilt profile."""
    old = prev.select(*keys, F.col("profile_version").alias("_v"))
    return new.join(old, list(keys), "left").withColumn("profile_version", F.coalesce("_v", F.lit(0)) + 1).drop("_v")


def detect_drift(new: DataFrame, prev: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Compare each profile with its previous build: amount jump, other main city, new country.

    A previous profile that has no drift status yet is not compared.
    """
    old = prev.select(
        "entity_key", F.col("decayed_avg_amount").alias("_avg"), F.col("usual_cities").alias("_cities"),
        F.col("usual_countries").alias("_countries"), F.col("drift_status").isNotNull().alias("_known"))
    both = new.join(old, "entity_key", "left")

    def main_value(m: str) -> Column:
        ranked = F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct((-e["value"]).alias("c"), e["key"].alias("v"))))
        return F.get(ranked, F.lit(0))["v"]

    change = F.try_divide(F.abs(F.col("decayed_avg_amount") - F.col("_avg")), F.col("_avg"))
    jump = F.when(
        (F.col("_avg") > 0) & (change >= cfg.drift_amount_pct),
        F.format_string("amount %s %.0f%%", F.when(F.col("decayed_avg_amount") > F.col("_avg"), "up").otherwise("down"), change * 100))
    was, now = main_value("_cities"), main_value("usual_cities")
    moved = F.when(was != now, F.concat(F.lit("main city "), was, F.lit("->"), now))
    fresh = F.array_sort(F.array_except(F.map_keys("usual_countries"), F.map_keys("_countries")))
    abroad = F.when(
        (F.size("_countries") > 0) & (F.size(fresh) > 0),
        F.concat(F.lit("new country "), F.array_join(F.slice(fresh, 1, 2), ",")))
    reasons = F.when(F.col("_known"), F.array_compact(F.array(jump, moved, abroad)))
    reason = F.nullif(F.array_join(reasons, "; "), F.lit(""))
    return both.withColumn("drift_reason", reason).withColumn(
        "drift_status", F.when(F.col("drift_reason").isNotNull(), "sudden").otherwise("none")
    ).drop("_avg", "_cities", "_countries", "_known")


def retrain_decision(new_txns: Column, prev_known: Column, prev_drift: Column, drift: Column, age_days: Column,
                     incremental: bool = True, cfg: Settings = DEFAULTS) -> Column:
    """Why a profile is rewritten, first reason that applies; 'unchanged' means it is only touched."""
    if not incremental:
        return F.lit("full_build")
    return (
        F.when(~prev_known, "new_profile").when(prev_drift.isNull(), "init").when(drift == "sudden", "drift")
        .when(new_txns >= cfg.retrain_min_new, F.concat(new_txns.cast("string"), F.lit("_new_txns")))
        .when(F.coalesce(age_days >= cfg.retrain_max_age_days, F.lit(False)), "periodic").otherwise("unchanged"))
