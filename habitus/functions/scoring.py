"""From detector scores to decisions: blending, normalisation, tiers, triggered signals, reasons and narrative.

Everything is a column expression, so a whole table is decided and explained inside one generated stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from habitus.config import CODES, DEFAULT_CUTS, DEFAULTS, DETECTOR_LABELS, SIGNAL_GROUPS, ZONES

BURST_3M, BURST_1M = 1.39, 1.10
SUB_BURST = ("vel_1m", "vel_2m", "vel_3m", "vel_10m", "vel_15m", "vel_1h")


def ecdf_lookup(quantiles: Column, x: Column) -> Column:
    """Share of the stored, sorted quantiles that are at most x.

    Two short searches instead of one long one: first which block of 32, then where in the block.
    """
    block = 32
    heads = F.transform(F.sequence(F.lit(0), F.floor((F.size(quantiles) - 1) / block)), lambda i: F.get(quantiles, (i * block).cast("int")))
    full = F.greatest(F.size(F.filter(heads, lambda q: q <= x)) - 1, F.lit(0)) * block
    inside = F.size(F.filter(F.slice(quantiles, full + 1, F.lit(block)), lambda q: q <= x))
    return (full + inside) / F.size(quantiles)


def _total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def blend(scores: dict[str, Column], weights: dict[str, float] | None = None, mode: str = DEFAULTS.blend_mode) -> tuple[Column, Column]:
    """Risk and confidence from the detectors that are present (non-null).

    Weights are renormalised over the present detectors. 'escalate' never falls below the second-highest score;
    a single detector always speaks for itself.
    """
    weights = {**DEFAULTS.weights, **(weights or {})}
    zero = F.lit(0.0)
    present = {k: s.isNotNull() for k, s in scores.items()}
    n = _total([p.cast("int") for p in present.values()])
    total = _total([F.when(present[k], F.lit(weights.get(k, 0.0))).otherwise(zero) for k in scores])
    weighted = _total([F.coalesce(s * F.lit(weights.get(k, 0.0)), zero) for k, s in scores.items()])
    mean = weighted / F.when(total == 0, 1.0).otherwise(total)
    ranked = F.sort_array(F.array_compact(F.array(*scores.values())), asc=False)
    if mode == "mean":
        risk = mean
    elif mode == "max":
        risk = F.get(ranked, F.lit(0))
    elif mode == "noisy_or":
        clipped = [1.0 - F.least(F.greatest(F.coalesce(s, zero), zero), F.lit(1.0)) for s in scores.values()]
        risk = 1.0 - reduce(lambda a, b: a * b, clipped)
    else:
        risk = F.greatest(mean, F.get(ranked, F.lit(1)))
    risk = F.when(n == 1, mean).otherwise(risk)
    plain = _total([F.coalesce(s, zero) for s in scores.values()]) / n
    variance = _total([F.coalesce((s - plain) * (s - plain), zero) for s in scores.values()]) / n
    agree = 1.0 - F.least(F.sqrt(variance) / 0.5, F.lit(1.0))
    extreme = F.abs(risk - 0.5) * 2.0
    certainty = F.least(F.greatest(0.5 * agree + 0.5 * extreme, F.lit(0.05)), F.lit(0.99))
    known = n > 0
    return F.when(known, F.least(F.greatest(risk, zero), F.lit(1.0))), F.when(known, certainty)


def value(feature: str) -> Column:
    return F.coalesce(F.col(feature), F.lit(0.0))


def primary_code() -> Column:
    """Unsafe code of the feature group with the largest deviation; the earlier group wins ties."""
    peaks = [F.greatest(*[F.abs(value(f)) for f in group]) for _, group in SIGNAL_GROUPS]
    top = F.greatest(*peaks)
    return reduce(lambda rest, pair: F.when(pair[1] == top, pair[0]).otherwise(rest),
                  reversed(list(zip([c for c, _ in SIGNAL_GROUPS], peaks))), F.lit(SIGNAL_GROUPS[0][0]))


def activity_code(risk: Column, cuts: dict[str, float] | dict[str, Column] | None = None) -> Column:
    """Code from the risk and the three cuts; below review, half the scale separates known patterns from the rest."""
    c = {**DEFAULT_CUTS, **(cuts or {})}
    return (
        F.when(risk >= c["unsafe_high"], "BF-400").when(risk >= c["unsafe"], primary_code()).when(risk >= c["review"], "BF-200")
        .when(risk < 0.5, "BF-110").otherwise("BF-100"))


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def decide(df: DataFrame, cuts: dict | None = None, risk: str = "risk_score") -> DataFrame:
    """Add activity code, status, zone, zone label and recommended queue."""
    df = df.withColumn("activity_code", activity_code(F.col(risk), cuts))
    df = df.withColumn("status", lookup({k: v[0] for k, v in CODES.items()}, F.col("activity_code")))
    return df.withColumns({
        name: lookup({s: z[i] for s, z in ZONES.items()}, F.col("status"))
        for i, name in enumerate(("zone", "zone_label", "recommended_queue"))})


def amount_vs_max() -> Column:
    """'exceeds' above the customer's maximum, 'at' within one part in a million of it, '' below."""
    return F.when(value("above_max") >= 1, "exceeds").when(value("amt_over_max") >= 1.0 - 1e-6, "at").otherwise("")


def is_burst() -> Column:
    return (value("vel_3m") >= BURST_3M) | (value("vel_1m") >= BURST_1M)


def is_recent() -> Column:
    return ~is_burst() & reduce(lambda a, b: a | b, [value(c) > 0 for c in SUB_BURST])


def is_fanout() -> Column:
    return (value("g_fanout") >= 0.9) & (value("g_distinct_benef") >= 1.6)


def signal_table() -> list[tuple[str, Column, str, str | None]]:
    """(code, predicate, analyst phrase, phrase for cold-start customers) in reporting order."""
    vs_max = amount_vs_max()
    # Signal codes and analyst phrases.
    return [
        ("amount_above_historical_max", vs_max == "exceeds", "amount exceeds the customer's historical maximum",
         "amount exceeds the population baseline maximum"),
        ("amount_at_historical_max", vs_max == "at", "amount is at the customer's historical maximum",
         "amount is at the population baseline maximum"),
        ("amount_far_above_usual", (value("amt_z") >= 3) | (value("amt_over_median") >= 5), "amount far above the customer's usual",
         "transaction amount is far above the population baseline"),
        ("new_beneficiary", value("beneficiary_new") >= 1, "first-time beneficiary", None),
        ("new_location", value("location_new") >= 1, "location the customer has not used before", None),
        ("new_country", value("country_new") >= 1, "country the customer has not used before", None),
        ("cross_border", value("cross_border") >= 1, "cross-border transfer", None),
        ("unusual_hour", value("hour_rarity") > 0.9, "uncommon hour for this customer", None),
        ("night_time", value("is_night") >= 1, "night-time transaction", None),
        ("unusual_day", value("dow_rarity") > 0.9, "uncommon day of week for this customer", None),
        ("velocity_burst", is_burst(), "burst of transactions in a short window (1-3 min)", None),
        ("recent_activity", is_recent(), "recent transaction activity contributed to the elevated risk score, although the burst "
         "threshold was not reached", None),
        ("shared_counterparty", value("g_shared_cp") >= 2, "beneficiary is shared by many customers (possible collector)", None),
        ("rare_transaction_type", value("type_rare") >= 1, "an unusual transaction type for this customer", None),
        ("new_ip", value("ip_new") >= 1, "a device / IP address the customer has not used before", None),
        ("high_fanout", is_fanout(), "funds sent to an unusually large number of distinct recipients (fan-out)", None),
        ("hourly_amount_spike", value("amt_1h_ratio") >= 2.0, "amount far above the customer's recent hourly average", None),
    ]


def triggered_signals() -> Column:
    """Codes of the behavioural signals that fired, in reporting order."""
    return F.array_compact(F.array(*[F.when(p, code) for code, p, _, _ in signal_table()]))


def high_detectors(scores: dict[str, Column], high: float) -> Column:
    """Detectors at or above the reporting level as (negated score, name), strongest first."""
    return F.array_sort(F.array_compact(F.array(*[
        F.when(s >= high, F.struct((-s).alias("neg"), F.lit(k).alias("name"))) for k, s in scores.items()])))


def explain(df: DataFrame, scores: dict[str, Column], cold: str = "is_cold_start", high: float = DEFAULTS.detector_high) -> DataFrame:
    """Add `triggered_signals` and `detection_reason`; both are empty for safe rows."""
    is_cold = F.coalesce(F.col(cold), F.lit(False))
    phrases = F.array_compact(F.array(*[
        F.when(p, F.when(is_cold, c).otherwise(t) if c else F.lit(t)) for _, p, t, c in signal_table()]))
    flagged = high_detectors(scores, high)
    codes = F.transform(flagged, lambda e: F.concat(F.lit("detector:"), e["name"]))
    notes = F.transform(flagged, lambda e: F.concat(
        F.coalesce(lookup(DETECTOR_LABELS, e["name"]), e["name"]), F.lit(" anomaly score "), F.format_string("%.2f", -e["neg"])))
    none = F.array().cast("array<string>")
    cold_code = F.when(is_cold, F.array(F.lit("cold_start"))).otherwise(none)
    cold_note = F.when(is_cold, F.array(F.lit(
        "no learned profile for this customer yet (cold-start) — judged against the population baseline"))).otherwise(none)
    quiet = F.col("status") == "safe"
    return df.withColumns({
        "triggered_signals": F.when(quiet, none).otherwise(F.concat(triggered_signals(), codes, cold_code)),
        "detection_reason": F.when(quiet, none).otherwise(F.concat(phrases, notes, cold_note)),
    })


def joined(items: Column, sep: str, last: str) -> Column:
    """Join a list; the final item gets its own separator."""
    n = F.size(items)
    return F.when(n <= 1, F.array_join(items, "")).otherwise(
        F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), sep), F.lit(last), F.element_at(items, -1)))


def evidence() -> list[tuple[Column, Column, Column]]:
    """(predicate, noun phrase, verb phrase) of the non-amount evidence, in narrative order."""
    night, rare_hour = value("is_night") >= 1, value("hour_rarity") > 0.9
    count = F.greatest(F.rint(F.expm1(F.greatest(value("vel_3m"), value("vel_1m")))).cast("int"), F.lit(2)).cast("string")

    def text(t: str) -> Column:
        return F.lit(t)

    # Phrases of the analyst narrative.
    return [
        (value("beneficiary_new") >= 1, text("a new beneficiary"), text("involves a first-time beneficiary")),
        ((value("location_new") >= 1) | (value("country_new") >= 1), text("a new location"), text("originates from a new location")),
        (value("cross_border") >= 1, text("cross-border activity"), text("crosses international borders")),
        (rare_hour, F.when(night, "an unusual hour, at night").otherwise("an unusual hour"),
         F.when(night, "occurs at an unusual hour (night-time)").otherwise("occurs at an unusual hour")),
        (~rare_hour & night, text("a night-time transaction"), text("occurs at night")),
        (is_burst(), F.concat(text("a burst of approximately "), count, text(" transactions within a few minutes")),
         F.concat(text("follows a burst of approximately "), count, text(" transactions within minutes"))),
        (is_recent(), text("recent transaction activity below the burst threshold"),
         text("follows recent account activity that contributed to the elevated risk score, although the burst threshold was not reached")),
        (value("amt_1h_ratio") >= 2.0, text("a spike in their spending over the last hour"), text("spikes the last hour's spending")),
        (is_fanout(), text("funds fanned out to many distinct recipients"), text("fans funds out to many distinct recipients")),
        (value("type_rare") >= 1, text("an unusual transaction type"), text("uses an unusual transaction type")),
        (value("ip_new") >= 1, text("a new device/IP"), text("uses a previously unseen device/IP")),
    ]


def narrative(scores: dict[str, Column], cold: str = "is_cold_start", high: float = DEFAULTS.detector_high) -> Column:
    """The analyst's description: the decision first, then the amount, the other evidence and the detectors."""
    is_cold = F.coalesce(F.col(cold), F.lit(False))
    usual = F.when(is_cold, "the typical amount").otherwise("the customer's typical amount")
    versus = F.when(is_cold, "").otherwise(amount_vs_max())
    times = value("amt_over_median")
    # Sentence templates of the narrative.
    tail = F.when(versus == "exceeds", " and exceeds their historical maximum").when(
        versus == "at", " and is at their historical maximum").otherwise("")
    amount = (
        F.when(times >= 2, F.concat(F.lit("the transaction amount is approximately "), F.format_number(F.bround(times), 0), F.lit("× "), usual, tail))
        .when(versus == "exceeds", "the transaction amount exceeds the customer's historical maximum")
        .when(versus == "at", "the transaction amount is at the customer's historical maximum"))
    sentence = F.concat(F.upper(F.left(amount, F.lit(1))), F.right(amount, F.length(amount) - 1), F.lit("."))
    rows = evidence()
    nouns = F.array_compact(F.array(amount, *[F.when(p, n) for p, n, _ in rows]))
    verbs = F.array_compact(F.array(*[F.when(p, v) for p, _, v in rows]))
    detectors = F.array_compact(F.array(*[F.when(s >= high, DETECTOR_LABELS.get(k, k)) for k, s in scores.items()]))
    signals, has_amount, has_verbs = F.size(nouns), amount.isNotNull(), F.size(verbs) > 0
    has_detectors = F.size(detectors) > 0
    lead = F.when(
        F.col("status") == "unsafe",
        F.when(signals >= 2, "Strong multi-signal behavioural anomaly — high risk; immediate review recommended.")
        .when(has_detectors, "Strong ensemble-detected behavioural anomaly — high risk; immediate review recommended.")
        .otherwise("Strong behavioural anomaly — high risk; immediate review recommended."),
    ).otherwise(
        F.when(signals + F.size(detectors) >= 3, "Strong behavioural anomaly detected — review recommended.")
        .otherwise("Mild behavioural anomaly — monitor."))
    more = F.when(has_verbs, F.concat(
        F.when(has_amount, "In addition, the transaction ").otherwise("The transaction "), joined(verbs, ", ", ", and "), F.lit(".")))
    context = F.when(is_cold, "The customer is in cold-start, so the transaction was evaluated against the population baseline rather than "
                     "an established personal behavioural profile.")
    models = F.when(has_detectors, F.concat(
        joined(detectors, ", ", " and "), F.when(has_amount | has_verbs, " also ").otherwise(" "), F.lit("produced very high anomaly scores.")))
    flagged = F.concat_ws(" ", lead, sentence, more, context, models)
    calm = F.when(signals > 0, F.concat(
        F.lit("Safe. The transaction is generally consistent with the customer's behavioural profile. Some variation was noted ("),
        joined(nouns, "; ", "; and "), F.lit("), but the overall behavioural risk remains below the review threshold."),
    )).otherwise("Safe. Consistent with the customer's behaviour.")
    return F.when(F.col("status") == "safe", calm).otherwise(flagged)


def zones(cuts: DataFrame) -> DataFrame:
    """Threshold hand-over: one row per zone with bounds, range text and action, from a (review, unsafe) table."""
    def text(c: str) -> Column:
        return F.format_string("%.4f", c)

    none = F.lit(None).cast("double")
    rows = {
        "safe": (none, F.col("review"), F.concat(F.lit("score < "), text("review"))),
        "review": (F.col("review"), F.col("unsafe"), F.concat(text("review"), F.lit(" <= score < "), text("unsafe"))),
        "unsafe": (F.col("unsafe"), none, F.concat(F.lit("score >= "), text("unsafe"))),
    }
    built = [F.struct(F.lit(ZONES[s][0]).alias("zone"), F.lit(s).alias("status"), F.round(lo, 4).alias("lower"), F.round(hi, 4).alias("upper"),
                      r.alias("range"), F.lit(ZONES[s][2]).alias("action")) for s, (lo, hi, r) in rows.items()]
    return cuts.select(F.inline(F.array(*built)))
