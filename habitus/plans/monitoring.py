"""Queries of the monitoring and analyst operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from habitus.config import DEFAULTS
from habitus.functions.maps import map_text
from habitus.functions.normalize import exact_sum, normalize_currency
from habitus.operators import analyst as A, baseline as B, filters as L, monitor as M, profile as P
from habitus.plans.ctes import MODEL_BASE, PROFILE_BASE, SANE, TXN, with_
from habitus.plans.ingesting import CFG, PROF, TRUST, small_profiles
from habitus.plans.modelling import AMOUNTS, BASELINE, DRIFT_CTE, MEMBERS, MEM_PAST, MIDS, PAST, SETS, TW, TWO, learned_view, training, two_models
from habitus.plans.profiling import AGED, CCY, clean_rows
from habitus.plans.registry import query
from habitus.sources.logs import log_rows
from habitus.sources.tables import event_stream_table, load, transactions

DECISIONS = """dec AS (SELECT event_id AS id, CAST(event_id // 2 AS VARCHAR) AS transaction_id, CAST(user_id AS VARCHAR) AS entity_key,
  CASE event_type WHEN 'error' THEN 'unsafe' WHEN 'purchase' THEN 'review' ELSE 'safe' END AS decision, value AS latency_ms, ts AS scored_at, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"""
FEEDBACK = """fb AS (SELECT transaction_id, CASE WHEN max(k) < 40 THEN 'Fraud' ELSE 'genuine' END AS verdict, max(scored_at) AS created_at FROM dec GROUP BY 1 HAVING max(k) < 75)"""
LAST = "last_dec AS (SELECT * FROM dec QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY scored_at DESC, id DESC) = 1)"


def decisions(spark, d):
    """Events as decisions; two events share a transaction, so most transactions were decided twice."""
    e = event_stream_table(spark, d)
    return e.select(
        F.col("event_id").alias("id"), F.expr("cast(event_id div 2 AS string)").alias("transaction_id"), F.col("customer_key").alias("entity_key"),
        F.expr("CASE category WHEN 'error' THEN 'unsafe' WHEN 'purchase' THEN 'review' ELSE 'safe' END").alias("decision"),
        F.col("amount").alias("latency_ms"), F.col("ts").alias("scored_at"), "category", "k")


def feedback(dec):
    return dec.groupBy("transaction_id").agg(F.max("k").alias("k"), F.max("scored_at").alias("created_at")).where("k < 75").select(
        "transaction_id", F.expr("CASE WHEN k < 40 THEN 'Fraud' ELSE 'genuine' END").alias("verdict"), "created_at")


def now(dec):
    return dec.agg(F.max("scored_at")).scalar()


@query("w06_latest_decision", with_(DECISIONS, LAST) + "SELECT transaction_id, id, decision FROM last_dec")
def w06(spark, d):
    return M.latest_decisions(decisions(spark, d)).select("transaction_id", "id", "decision")


@query("j09_decisions_with_verdict", with_(DECISIONS, FEEDBACK, LAST) + "SELECT transaction_id, decision, lower(verdict) AS verdict FROM last_dec JOIN fb USING (transaction_id) WHERE created_at > (SELECT max(scored_at) FROM dec) - INTERVAL 20 DAY")
def j09(spark, d):
    dec = decisions(spark, d)
    return M.decisions_with_verdict(dec, feedback(dec), now(dec), 20).select("transaction_id", "decision", "verdict")


@query("o01_live_flag_rate", with_(DECISIONS) + """, r AS (SELECT count(*) AS total, count(*) FILTER (WHERE decision <> 'safe') AS flagged, count(*) FILTER (WHERE decision = 'unsafe') AS unsafe FROM dec WHERE scored_at > (SELECT max(scored_at) FROM dec) - INTERVAL 48 HOUR)
SELECT total, flagged, unsafe, round(flagged / total::DOUBLE, 4) AS flag_rate, total >= 200 AS enough, CASE WHEN total >= 200 AND flagged / total::DOUBLE > 0.3 THEN 'over-flagging' WHEN total >= 200 AND flagged / total::DOUBLE < 0.02 THEN 'under-flagging' ELSE '' END AS problems FROM r""")
def o01(spark, d):
    dec = decisions(spark, d)
    return M.check_live(dec, now(dec), 48).select("total", "flagged", "unsafe", "flag_rate", "enough", F.array_join("problems", ",").alias("problems"))


@query("o02_live_precision", with_(DECISIONS, FEEDBACK, LAST) + """, b AS (SELECT decision <> 'safe' AS f, lower(verdict) = 'fraud' AS v FROM last_dec JOIN fb USING (transaction_id) WHERE created_at > (SELECT max(scored_at) FROM dec) - INTERVAL 30 DAY),
c AS (SELECT count(*) FILTER (WHERE f AND v) AS tp, count(*) FILTER (WHERE f AND NOT v) AS fp, count(*) FILTER (WHERE NOT f AND v) AS fn, count(*) FILTER (WHERE NOT f AND NOT v) AS tn FROM b)
SELECT *, tp + fp + fn + tn AS labels, tp + fp + fn + tn >= 20 AS enough, round(tp / (tp + fp)::DOUBLE, 4) AS precision, round(tp / (tp + fn)::DOUBLE, 4) AS recall FROM c""")
def o02(spark, d):
    dec = decisions(spark, d)
    return M.live_precision(dec, feedback(dec), now(dec))


@query("o05_model_retrain_trigger", with_(TXN, SANE, DRIFT_CTE) + """, ps AS (SELECT round(sum(((c + 1e-6) - (r + 1e-6)) * ln((c + 1e-6) / (r + 1e-6))), 4) AS p FROM fr)
SELECT *, n_reasons > 0 AS should_retrain FROM (SELECT *, (new_transactions >= {new})::INT + (age_days >= {days})::INT + (amount_psi >= {psi})::INT AS n_reasons FROM
  (SELECT (SELECT count(*) FROM cur) AS new_transactions, (epoch_us((SELECT max(ts) FROM sane)) - epoch_us((SELECT max(ts) FROM ref))) // 86400000000 AS age_days, p AS amount_psi FROM ps))""".format(
    new=DEFAULTS.retrain_min_new, days=DEFAULTS.retrain_max_age_days, psi=DEFAULTS.psi_threshold))
def o05(spark, d):
    sane = L.sane_amount(transactions(spark, d))
    mark = B.watermark_of(sane.where("ts < TIMESTAMP '2000-01-01'"))
    later = sane.where("ts >= TIMESTAMP '2000-01-01'")
    return M.model_retrain_trigger(mark, later, P.newest(sane)).select("new_transactions", "age_days", "amount_psi", "should_retrain", F.size("reasons").alias("n_reasons"))


@query("o06_changed_alerts", """WITH a AS (SELECT event_id AS id, user_id, event_type AS signature, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT id, signature FROM a WHERE p IS NULL OR p <> signature""")
def o06(spark, d):
    rows = event_stream_table(spark, d).select(F.col("event_id").alias("id"), F.col("customer_key").alias("alert_key"), "ts", F.col("category").alias("signature"))
    return M.changed_alerts(rows).select("id", "signature")


@query("o20_linked_feedback", with_(DECISIONS, LAST) + """, vs AS (SELECT CAST(event_id // 3 AS VARCHAR) AS transaction_id, CASE event_type WHEN 'click' THEN 'Legit' WHEN 'view' THEN 'BAD' WHEN 'error' THEN 'true_positive' END AS w, ts, event_id FROM events WHERE event_type IN ('click', 'view', 'error')),
nv AS (SELECT transaction_id, CASE w WHEN 'Legit' THEN 'genuine' ELSE 'fraud' END AS verdict FROM vs QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY ts DESC) = 1),
old AS (SELECT CAST(c_custkey AS VARCHAR) AS transaction_id, concat('old', c_custkey) AS entity_key, 'safe' AS decision, 'genuine' AS verdict FROM customer)
SELECT coalesce(n.transaction_id, o.transaction_id) AS transaction_id, coalesce(l.entity_key, o.entity_key) AS entity_key, coalesce(l.decision, o.decision) AS decision, coalesce(n.verdict, o.verdict) AS verdict,
  o.verdict IS NOT NULL AND n.verdict IS NOT NULL AS was_update FROM nv n FULL JOIN old o ON n.transaction_id = o.transaction_id LEFT JOIN last_dec l ON l.transaction_id = n.transaction_id""")
def o20(spark, d):
    words = F.expr("CASE category WHEN 'click' THEN 'Legit' WHEN 'view' THEN 'BAD' WHEN 'error' THEN 'true_positive' ELSE 'dunno' END")
    verdicts = event_stream_table(spark, d).select(F.expr("cast(event_id div 3 AS string)").alias("transaction_id"), words.alias("verdict"), F.col("ts").alias("created_at"), "event_id")
    key = F.col("c_custkey").cast("string")
    old = load(spark, d, "customer").select(key.alias("transaction_id"), F.concat(F.lit("old"), key).alias("entity_key"), F.lit("safe").alias("decision"), F.lit("genuine").alias("verdict"))
    return M.link_feedback(verdicts, decisions(spark, d), old, ("event_id",))  # the SQL orders by time alone; of equal times DuckDB keeps the row that is stored first


@query("o18_run_summary", with_(DECISIONS) + """SELECT 'decision' AS what, decision AS value, count(*) AS n FROM dec GROUP BY 2 UNION ALL
SELECT 'code', CASE decision WHEN 'unsafe' THEN 'BF-400' WHEN 'review' THEN 'BF-200' ELSE 'BF-100' END, count(*) FROM dec GROUP BY 2""")
def o18(spark, d):
    codes = F.expr("CASE decision WHEN 'unsafe' THEN 'BF-400' WHEN 'review' THEN 'BF-200' ELSE 'BF-100' END")
    return M.run_summary(decisions(spark, d).withColumn("activity_code", codes))


LAT = "round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms, round(quantile_cont(latency_ms, 0.99), 6) AS p99_ms"


@query("o18_latency", with_(DECISIONS) + f"SELECT count(*) AS requests, round(avg(latency_ms), 6) AS avg_ms, max(latency_ms) AS max_ms, {LAT} FROM dec")
def o18_latency(spark, d):
    out = M.latency_summary(decisions(spark, d))
    return out.select("requests", "max_ms", *[F.round(c, 6).alias(c) for c in ("avg_ms", "p50_ms", "p95_ms", "p99_ms")])


@query("o19_sla_report", with_(DECISIONS) + f"""SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS failures, count(*) FILTER (WHERE event_type <> 'error' AND latency_ms > 150) AS sla_breaches,
  round(100.0::DOUBLE * count(*) FILTER (WHERE event_type <> 'error' AND latency_ms > 150) / count(*) FILTER (WHERE event_type <> 'error'), 2) AS breach_pct, max(latency_ms) AS max_ms, {LAT}, quantile_cont(latency_ms, 0.95) <= 150 AS sla_met_at_p95 FROM dec""")
def o19(spark, d):
    out = M.sla_report(decisions(spark, d).withColumn("ok", F.col("category") != "error"), 150.0)
    return out.drop("avg_ms").withColumns({c: F.round(c, 6) for c in ("p50_ms", "p95_ms", "p99_ms")})


LOG = """lg AS (SELECT event_type AS status, CASE WHEN event_type = 'error' THEN 'unavailable' ELSE 'coordinates' END AS geo_source, CASE WHEN event_type = 'error' THEN 'no_evidence' END AS reason,
  CASE WHEN event_type <> 'error' THEN value * 2 END AS metres, CASE WHEN event_type = 'click' THEN value * 10 END AS kmh FROM events WHERE event_type <> 'signup')"""


def scoring_log(spark, d):
    return log_rows(event_stream_table(spark, d))


@query("o15_geo_sources", with_(LOG) + "SELECT geo_source, reason, count(*) AS n FROM lg GROUP BY 1, 2")
def o15(spark, d):
    return M.geo_sources(scoring_log(spark, d))


@query("o15_geo_velocity", with_(LOG) + """, s AS (SELECT kmh, row_number() OVER (ORDER BY kmh) - 1 AS i, count(*) OVER () AS n FROM lg WHERE kmh IS NOT NULL)
SELECT count(*) AS calculable, count(*) FILTER (WHERE kmh > 0) AS nonzero, min(kmh) AS min_kmh, max(kmh) AS max_kmh, count(*) FILTER (WHERE kmh >= 900) AS high, 0 AS high_safe, 0 AS high_review, 0 AS high_unsafe,
  round(quantile_cont(kmh, 0.5), 6) AS median_kmh, max(kmh) FILTER (WHERE i = least(n - 1, floor(n * 0.9::DOUBLE))) AS p90_kmh, max(kmh) FILTER (WHERE i = least(n - 1, floor(n * 0.95::DOUBLE))) AS p95_kmh FROM s""")
def o15_velocity(spark, d):
    return M.geo_velocity_report(scoring_log(spark, d)).withColumn("median_kmh", F.round("median_kmh", 6))


@query("o15_geo_precision", with_(LOG) + "SELECT geo_source, count(*) AS n, max(metres) AS max_m, round(quantile_cont(metres, 0.5), 6) AS median_m FROM lg WHERE metres IS NOT NULL GROUP BY 1")
def o15_precision(spark, d):
    return M.geo_precision(scoring_log(spark, d)).withColumn("median_m", F.round("median_m", 6))


@query("o16_plus_code_sample", with_(*MODEL_BASE) + """SELECT customer_key, count(*) AS n FROM (SELECT customer_key, concat(customer_location, CASE WHEN amount > 50000 THEN ' GGVW+VH' ELSE '' END) AS loc FROM valid)
WHERE loc LIKE '%+%' AND customer_key IN (SELECT customer_key FROM eligible) GROUP BY 1 HAVING count(*) >= 2""")
def o16(spark, d):
    from habitus.plans.normalisation import FIXTURE_ML
    valid = L.validate(transactions(spark, d))
    eligible = L.ml_eligible(valid.where(~L.weak_bad()), **FIXTURE_ML).where("eligible")
    located = F.concat("customer_location", F.when(F.col("amount") > 50000, " GGVW+VH").otherwise(""))
    return M.plus_code_sample(valid.withColumn("customer_location", located), eligible)


PROFILES = PROFILE_BASE + (PROF,)


def cities(profiles):
    """Customers of some branches have no learned place yet."""
    named = F.create_map(F.lit("Lagos"), F.lit(1).cast("long"))
    return profiles.withColumn("usual_cities", F.when(F.col("branch_id") >= 3, named).otherwise(F.create_map().cast("map<string,bigint>")))


@query("f10_browse_untrusted", with_(*PROFILES) + f"SELECT entity_key, total_tx_count, {TRUST} AS trust_reason FROM prof WHERE branch_id >= 3 AND contains(lower(customer_name), '12') AND {TRUST} <> 'own_profile' ORDER BY total_tx_count DESC, entity_key LIMIT 100")
def f10(spark, d):
    return A.browse(cities(small_profiles(clean_rows(spark, d))), "12", False, 500, CFG).select("entity_key", "total_tx_count", "trust_reason")


@query("t01_top_customers", with_(*PROFILES) + "SELECT entity_key, total_tx_count, avg_amount FROM prof WHERE branch_id >= 3 ORDER BY total_tx_count DESC, entity_key LIMIT 25")
def t01(spark, d):
    return A.browse(cities(small_profiles(clean_rows(spark, d))), limit=25, cfg=CFG).select("entity_key", "total_tx_count", "avg_amount")


@query("o22_customer_panel", with_(*PROFILES) + f"""SELECT * FROM (SELECT entity_key, profile_status, total_tx_count FROM prof WHERE branch_id >= 3 AND {TRUST} = 'own_profile' ORDER BY total_tx_count DESC, entity_key LIMIT 3)
UNION ALL SELECT * FROM (SELECT entity_key, profile_status, total_tx_count FROM prof WHERE profile_status = 'warming_up' ORDER BY total_tx_count DESC, entity_key LIMIT 2)""")
def o22(spark, d):
    return A.sample_customers(cities(small_profiles(clean_rows(spark, d))), CFG).select("entity_key", "profile_status", "total_tx_count")


@query("j11_resolve_customer", with_(TXN) + "SELECT DISTINCT identifier, customer_name, bvn, entity_key FROM txn WHERE contains(lower(customer_name), '77') ORDER BY customer_name, identifier LIMIT 25")
def j11(spark, d):
    return A.resolve_customer(transactions(spark, d), name="77")


MULTI = f"""multi AS (SELECT * REPLACE (CASE WHEN extract(year FROM ts) % 2 = 0 THEN 'USD' ELSE currency END AS currency) FROM aged),
pc AS (SELECT entity_key, {CCY} AS ccy, count(*) AS total_tx_count, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_amount, sum(w * amount) / sum(w) AS davg, (epoch_us(max(ts)) - epoch_us(min(ts))) // 86400000000 AS tenure_days FROM multi GROUP BY ALL),
pst AS (SELECT *, CASE WHEN total_tx_count >= 15 THEN 'active' ELSE 'warming_up' END AS profile_status, CASE WHEN tenure_days > 1500 THEN 'sudden' ELSE 'none' END AS drift_status FROM pc)"""
MULTI_BASE = with_(*PROFILE_BASE, AGED, MULTI)


def currency_profiles(spark, d):
    """Profiles per entity and currency."""
    clean = clean_rows(spark, d).withColumn("currency", normalize_currency(F.when(F.year("ts") % 2 == 0, "USD").otherwise(F.col("currency"))))
    base = P.core(clean, P.newest(clean), ("entity_key", "currency"), ["total_tx_count", "avg_amount", "decayed_avg_amount", "first_seen", "last_seen"])
    days = F.expr("(unix_micros(last_seen) - unix_micros(first_seen)) div 86400000000")
    return base.withColumns({
        "tenure_days": days, "profile_status": F.when(F.col("total_tx_count") >= 15, "active").otherwise("warming_up"),
        "drift_status": F.when(days > 1500, "sudden").otherwise("none"), "lifetime_clean_txns": F.col("total_tx_count"),
        "suspicious_tx_count": F.lit(0), "confidence_score": F.lit(80)})


@query("a21_store_stats", MULTI_BASE + """SELECT 'currency' AS measure, ccy AS value, count(*) AS n FROM pst GROUP BY 2 UNION ALL SELECT 'status', profile_status, count(*) FROM pst GROUP BY 2
UNION ALL SELECT 'drift', drift_status, count(*) FROM pst GROUP BY 2 UNION ALL SELECT 'rows', NULL, count(*) FROM pst UNION ALL SELECT 'customers', NULL, count(DISTINCT entity_key) FROM pst
UNION ALL SELECT 'peer_baselines', NULL, count(*) FROM nation""")
def a21(spark, d):
    return A.store_stats(currency_profiles(spark, d), load(spark, d, "nation"))


@query("o11_profile_list", MULTI_BASE + "SELECT entity_key, ccy AS currency, total_tx_count, row_number() OVER (PARTITION BY entity_key ORDER BY total_tx_count DESC, ccy) AS rank FROM pst")
def o11(spark, d):
    return A.profile_list(currency_profiles(spark, d)).select("entity_key", "currency", "total_tx_count", "rank")


@query("o10_customer_status", MULTI_BASE + """, ev AS (SELECT concat(c_nationkey, ':', c_custkey) AS entity_key, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events JOIN customer ON user_id = c_custkey),
le AS (SELECT entity_key, string_agg(event_type, ',' ORDER BY r) AS recent FROM ev WHERE r <= 10 GROUP BY 1)
SELECT p.entity_key, arg_max(ccy, (total_tx_count, -ascii(ccy) * 256 * 256 - ascii(ccy[2]) * 256 - ascii(ccy[3]))) AS currency, string_agg(concat(ccy, '=', total_tx_count), ',' ORDER BY total_tx_count DESC, ccy) AS currencies,
  arg_max(tenure_days, (total_tx_count, -ascii(ccy) * 256 * 256 - ascii(ccy[2]) * 256 - ascii(ccy[3]))) >= 800 AS tenure_met, max(total_tx_count) >= 25 AS clean_txns_met, coalesce(any_value(recent), '') AS recent FROM pst p LEFT JOIN le USING (entity_key) GROUP BY 1""")
def o10(spark, d):
    customer = load(spark, d, "customer")
    events = event_stream_table(spark, d).join(customer.withColumn("customer_key", F.col("c_custkey").cast("string")), "customer_key").select(
        F.concat_ws(":", "c_nationkey", "c_custkey").alias("entity_key"), F.lit("seen").alias("event_type"), F.col("category").alias("outcome"), "ts", "event_id")
    out = A.customer_status(currency_profiles(spark, d), events, CFG)
    return out.select(
        "entity_key", "currency", F.array_join(F.transform("currencies", lambda e: F.concat(e["currency"], F.lit("="), e["txns"].cast("string"))), ",").alias("currencies"),
        "tenure_met", "clean_txns_met", F.coalesce(F.array_join(F.transform("recent_events", lambda e: e["outcome"]), ","), F.lit("")).alias("recent"))


@query("o12_learned_view", with_(*MODEL_BASE, TW, MIDS, BASELINE) + """SELECT CAST(c_custkey AS VARCHAR) AS customer_key, b.n IS NULL AS is_cold_start, CASE WHEN b.n IS NULL THEN 'population' ELSE 'personal' END AS baseline_type, round(amt_median, 2) AS median
FROM customer LEFT JOIN base b ON b.customer_key = CAST(c_custkey AS VARCHAR)""")
def o12(spark, d):
    view = learned_view(spark, d)
    keys = load(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("customer_key"))
    return A.learned(view, keys).select("customer_key", "is_cold_start", "baseline_type", "median")


@query("o13_behaviour_change", TWO + f""", {MEMBERS}, p{MEM_PAST}, ch AS (SELECT coalesce(p.customer_key, c.customer_key) AS customer_key, count(*) FILTER (WHERE p.value IS NULL AND coalesce(p.kind, c.kind) = 'benefs') AS benefs_added,
  count(*) FILTER (WHERE c.value IS NULL AND coalesce(p.kind, c.kind) = 'benefs') AS benefs_removed, count(*) FILTER (WHERE p.value IS NULL AND coalesce(p.kind, c.kind) = 'locs') AS locs_added
  FROM pmem p FULL JOIN (SELECT * FROM mem WHERE customer_key IN (SELECT customer_key FROM late)) c ON p.customer_key = c.customer_key AND p.kind = c.kind AND p.value = c.value GROUP BY 1)
SELECT customer_key, CASE WHEN p.amt_median IS NULL THEN 'newly_learned' WHEN c.amt_median IS NULL THEN 'invalidated_to_coldstart' ELSE 'relearned' END AS transition, benefs_added, benefs_removed, locs_added
FROM ch LEFT JOIN pmed p USING (customer_key) LEFT JOIN (SELECT * FROM cur WHERE customer_key IN (SELECT customer_key FROM late)) c USING (customer_key)""")
def o13(spark, d):
    train = training(spark, d, *AMOUNTS, *SETS)
    prev, cur = two_models(train)
    late = train.groupBy("customer_key").agg(F.max("ts").alias("m")).where("m >= TIMESTAMP '2000-06-01'")
    changes = B.set_changes_since(train, F.expr("ts < TIMESTAMP '2000-01-01'"), current=late)
    return A.behaviour_change(B.diff_baselines(prev, cur), changes).select("customer_key", "transition", "benefs_added", "benefs_removed", "locs_added")


@query("o13_decay_evidence", MULTI_BASE + "SELECT entity_key, ccy AS currency, round(avg_amount - davg, 2) AS decay_gap FROM pst")
def o13_decay(spark, d):
    return A.decay_evidence(currency_profiles(spark, d))
