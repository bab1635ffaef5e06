"""Queries of the ingest, sink and governance operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from habitus.config import Settings
from habitus.functions.maps import json_to_map, map_text, map_to_json
from habitus.functions.normalize import exact_sum
from habitus.operators import filters as L, govern as V, profile as P, walkforward as W
from habitus.plans.ctes import CLEAN, LABELLED, PROFILE_BASE, SANE, TXN, UNIQ, VALID, with_
from habitus.plans.profiling import CCY, CUT, clean_rows, dsum, earlier
from habitus.plans.registry import query
from habitus.session import materialize, scratch
from habitus.sources import csv as C, ingest as I, logs as J, sinks as K, stored as T
from habitus.sources.tables import event_stream_table, load, transactions

ASOF = "(SELECT max(ts) FROM txn)"


def newest(txn):
    return txn.agg(F.max("ts")).scalar()


@query("s01_csv_scan", with_(TXN) + "SELECT transaction_id, version, CASE WHEN status IS NULL THEN NULL ELSE amount END AS amount, ts, branch_id FROM txn")
def s01(spark, d):
    """Written as text with a zone offset and some broken amounts, and read back tolerantly."""
    path = scratch(spark, "extract")
    txn = transactions(spark, d)
    amount = F.when(F.col("status").isNull(), "n/a").otherwise(F.col("amount").cast("string"))
    C.write_txn_csv(txn.withColumn("amount", amount), path)
    return C.read_txn_csv(spark, path).select("transaction_id", "version", "amount", "ts", "branch_id")


@query("s02_extract_window", with_(TXN) + f"SELECT transaction_id, version, amount, branch_id FROM txn WHERE ts >= {ASOF} - INTERVAL 3 MONTH AND origin_account_no NOT IN ('N/A', '')")
def s02(spark, d):
    txn = transactions(spark, d)
    return I.extract_window(txn, newest(txn), 3).select("transaction_id", "version", "amount", "branch_id")


@query("s02_extract_branch_limit", with_(TXN) + f"SELECT transaction_id, version, amount FROM txn WHERE ts >= {ASOF} - INTERVAL 24 MONTH AND branch_id = 7 ORDER BY ts, id, version, amount LIMIT 500")
def s02_limit(spark, d):
    txn = transactions(spark, d)
    return I.extract_window(txn, newest(txn), 24, branch=7, limit=500).select("transaction_id", "version", "amount")


MID = "(SELECT max(id) // 2 FROM txn)"


@query("s03_pull_new", with_(TXN) + f"SELECT id, version, amount FROM txn WHERE id > {MID}")
def s03(spark, d):
    txn = transactions(spark, d)
    return I.pull_new(txn, txn.agg(F.expr("max(id) div 2")).scalar()).select("id", "version", "amount")


@query("s03_pull_new_capped", with_(TXN) + f"SELECT id, version, amount FROM txn WHERE id > {MID} ORDER BY id, version, amount LIMIT 2000")
def s03_cap(spark, d):
    txn = transactions(spark, d)
    return I.pull_new(txn, txn.agg(F.expr("max(id) div 2")).scalar(), cap=2000).select("id", "version", "amount")


@query("s04_refresh_window", with_(TXN) + f"SELECT id, version, amount, status FROM txn WHERE ts >= {ASOF} - INTERVAL 30 DAY")
def s04(spark, d):
    txn = transactions(spark, d)
    return I.pull_refresh(txn, newest(txn), 30).select("id", "version", "amount", "status")


# a stored table that lags behind, and a delta that repeats part of it with changed statuses
OLD = f"old AS (SELECT id, version, amount, status FROM txn WHERE ts < TIMESTAMP '2000-06-01' QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC, amount DESC) = 1)"
DELTA = "delta AS (SELECT id, version, amount, 'reviewed' AS status FROM txn WHERE ts >= TIMESTAMP '2000-01-01')"


OLDT = OLD.replace("old AS", "oldt AS").replace("amount, status FROM", "amount, status, ts FROM")
DELTAT = "deltat AS (SELECT id, version, amount, 'reviewed' AS status, ts FROM txn WHERE ts >= TIMESTAMP '2000-05-01')"


def stored_and_delta(spark, d):
    txn = transactions(spark, d).select("id", "version", "amount", "status", "ts")
    old = L.latest(txn.where("ts < TIMESTAMP '2000-06-01'"), ["id"], ("version", "amount")).drop("ts")
    return old, txn.where("ts >= TIMESTAMP '2000-01-01'").withColumn("status", F.lit("reviewed")).drop("ts")


@query("s05_upsert", with_(TXN, OLD, DELTA) + """SELECT id, version, amount, status FROM delta QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC, amount DESC) = 1
UNION ALL SELECT * FROM old WHERE id NOT IN (SELECT id FROM delta)""")
def s05(spark, d):
    old, delta = stored_and_delta(spark, d)
    return I.upsert(old, delta, ["id"], ("version", "amount"))


@query("s06_upsert_coalesce", """WITH base AS (SELECT c_custkey, c_name AS label, c_mktsegment AS segment FROM customer WHERE c_acctbal < 5000),
delta AS (SELECT c_custkey, CASE WHEN c_nationkey < 10 THEN upper(c_name) END AS label, CASE WHEN c_nationkey >= 5 THEN 'NEW' END AS segment FROM customer WHERE c_acctbal > 2000)
SELECT coalesce(b.c_custkey, d.c_custkey) AS c_custkey, coalesce(d.label, b.label) AS label, coalesce(d.segment, b.segment) AS segment FROM base b FULL JOIN delta d ON b.c_custkey = d.c_custkey""")
def s06(spark, d):
    c = load(spark, d, "customer")
    base = c.where("c_acctbal < 5000").select("c_custkey", F.col("c_name").alias("label"), F.col("c_mktsegment").alias("segment"))
    delta = c.where("c_acctbal > 2000").select("c_custkey", F.expr("CASE WHEN c_nationkey < 10 THEN upper(c_name) END").alias("label"), F.expr("CASE WHEN c_nationkey >= 5 THEN 'NEW' END").alias("segment"))
    return I.upsert_coalesce(base, delta, ["c_custkey"], ["label", "segment"])


@query("s07_prune", with_(TXN) + f"SELECT id, version, amount FROM txn WHERE ts >= {ASOF} - INTERVAL 6 MONTH")
def s07(spark, d):
    txn = transactions(spark, d)
    return I.prune(txn, newest(txn), 6).select("id", "version", "amount")


@query("s08_rejects", with_(TXN) + """SELECT id, version, amount, array_to_string(list_filter([CASE WHEN NOT (amount > 0 AND amount <= 1e13) THEN 'amount' END, CASE WHEN status IS NULL THEN 'status' END,
  CASE WHEN destination_account_no IS NULL THEN 'destination' END], lambda x: x IS NOT NULL), ',') AS reasons FROM txn WHERE NOT (amount > 0 AND amount <= 1e13) OR status IS NULL OR destination_account_no IS NULL""")
def s08(spark, d):
    _, bad = I.split_rejects(transactions(spark, d), {
        "amount": (F.col("amount") > 0) & (F.col("amount") <= 1e13), "status": F.col("status").isNotNull(), "destination": F.col("destination_account_no").isNotNull()})
    return bad.select("id", "version", "amount", F.array_join("reasons", ",").alias("reasons"))


@query("s09_sync_state", with_(TXN) + """, s(source, last_id, rows_total) AS (VALUES ('sales', 1000, 500), ('idle', 99, 7)), b AS (SELECT max(id) AS i, count(*) AS n, max(ts) AS t FROM txn WHERE id > 1000)
SELECT source, CASE source WHEN 'sales' THEN greatest(last_id, i) ELSE last_id END AS last_id, CASE source WHEN 'sales' THEN rows_total + n ELSE rows_total END AS rows_total,
  CASE source WHEN 'sales' THEN t END AS newest, CASE source WHEN 'sales' THEN 'ok' ELSE 'idle' END AS last_status FROM s, b""")
def s09(spark, d):
    state = spark.createDataFrame([("sales", 1000, 500, None), ("idle", 99, 7, None)], "source string, last_id long, rows_total long, newest timestamp")
    return I.advance_watermark(state, I.pull_new(transactions(spark, d), 1000), "sales")


# every second event starts an attempt of a source, and the next one ends it, unless it crashed
ATTEMPTS = """att AS (SELECT event_id // 2 AS attempt, concat('s', event_id // 2 % 50) AS source, event_id // 2 * 10 AS last_id, event_id % 7 AS n, ts, event_id % 2 = 1 AND event_id % 11 <> 0 AS ends, event_id % 5 = 0 AS fails FROM events),
one AS (SELECT source, attempt, max(last_id) FILTER (WHERE ends AND NOT fails) AS last_id, max(n) FILTER (WHERE ends AND NOT fails) AS n, max(ts) FILTER (WHERE ends AND NOT fails) AS newest, bool_or(ends) AS ended, bool_or(ends AND fails) AS failed FROM att GROUP BY 1, 2)"""


@query("s09_sync_attempts", with_(ATTEMPTS) + """SELECT source, coalesce(max(last_id), 0) AS last_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows_total, max(newest) AS newest, max(attempt) AS last_attempt,
  CASE WHEN NOT arg_max(ended, attempt) THEN 'running' WHEN arg_max(failed, attempt) THEN 'failed' WHEN arg_max(coalesce(n, 0), attempt) > 0 THEN 'ok' ELSE 'idle' END AS last_status,
  CASE WHEN arg_max(failed, attempt) THEN concat('attempt ', max(attempt), ' broke off') END AS last_detail, count(*) FILTER (WHERE NOT ended AND attempt < mx) AS crashed
  FROM one JOIN (SELECT source, max(attempt) AS mx FROM one GROUP BY 1) USING (source) GROUP BY source""")
def s09_attempts(spark, d):
    at = load(spark, d, "events").select((F.expr("event_id DIV 2")).alias("attempt"), "event_id", "ts").withColumn("source", F.concat(F.lit("s"), F.col("attempt") % 50))
    ends, fails = (F.col("event_id") % 2 == 1) & (F.col("event_id") % 11 != 0), F.col("event_id") % 5 == 0
    phase = F.when(~ends, "started").when(fails, "failed").otherwise("committed")
    done = phase == "committed"
    log = at.select("source", "attempt", phase.alias("phase"), F.when(done, F.col("attempt") * 10).alias("last_id"), F.when(done, F.col("event_id") % 7).alias("rows"), F.when(done, F.col("ts")).alias("newest"),
                    F.when(phase == "failed", F.concat(F.lit("attempt "), "attempt", F.lit(" broke off"))).alias("detail"))
    return T.sync_state(log)


@query("s07_stored_days", with_(TXN, OLDT, DELTAT) + """SELECT id, version, amount, status FROM (SELECT id, version, amount, status, ts FROM deltat QUALIFY row_number() OVER (PARTITION BY id, date_trunc('month', ts) ORDER BY version DESC, amount DESC) = 1
  UNION ALL SELECT id, version, amount, status, ts FROM oldt WHERE (id, date_trunc('month', ts)) NOT IN (SELECT (id, date_trunc('month', ts)) FROM deltat)) WHERE ts >= TIMESTAMP '1999-06-15 12:00:00'""")
def s07_days(spark, d):
    """A table by month, a delta merged into the months it touches, and everything before a moment dropped."""
    path = scratch(spark, "days")
    txn = transactions(spark, d).select("id", "version", "amount", "status", "ts")
    T.write_days(L.latest(txn.where("ts < TIMESTAMP '2000-06-01'"), ["id"], ("version", "amount")), path, unit="month")
    T.merge_days(spark, path, txn.where("ts >= TIMESTAMP '2000-05-01'").withColumn("status", F.lit("reviewed")), ["id"], ("version", "amount"), unit="month")
    T.prune_days(spark, path, "1999-06-15 12:00:00", unit="month")
    return spark.read.parquet(path).select("id", "version", "amount", "status")


@query("s10_remaining", with_(TXN) + f"SELECT count(*) AS remaining FROM txn WHERE id > {MID} AND ts >= {ASOF} - INTERVAL 12 MONTH")
def s10(spark, d):
    txn = transactions(spark, d)
    return I.remaining(txn, txn.agg(F.expr("max(id) div 2")).scalar(), newest(txn), 12)


@query("s11_model_load", with_(TXN) + f"""SELECT customer_key, transaction_id, version, amount FROM txn WHERE ts >= {ASOF} - INTERVAL 24 MONTH
  AND CAST(concat('0x', substr(md5(concat_ws('|', transaction_id, version)), 1, 8)) AS BIGINT) < CAST(0.25 * 4294967296 AS BIGINT)""")
def s11(spark, d):
    txn = transactions(spark, d)
    return I.load_ml(txn, newest(txn), 24, sample=0.25).select("customer_key", "transaction_id", "version", "amount")


@query("s11_full_load", with_(TXN) + f"SELECT customer_key, transaction_id, version, amount FROM txn WHERE identifier IS NOT NULL AND ts >= {ASOF} - INTERVAL 24 MONTH")
def s11_full(spark, d):
    txn = transactions(spark, d)
    return I.load_ml(txn, newest(txn), 24).select("customer_key", "transaction_id", "version", "amount")


PREVNEW = f"""pv AS (SELECT entity_key, count(*) AS total, 1 AS profile_version FROM clean WHERE ts < {CUT} GROUP BY 1),
nw AS (SELECT entity_key, count(*) AS total, 2 AS profile_version, count(*) FILTER (WHERE ts >= {CUT}) >= 3 AS changed, max(ts) >= TIMESTAMP '1999-06-01' AS seen FROM clean GROUP BY 1)"""


def publish_inputs(spark, d):
    """Previous profiles, rewritten ones (three or more new rows) and the keys seen but not rewritten."""
    clean = clean_rows(spark, d)
    prev = earlier(clean).groupBy("entity_key").agg(F.count("*").alias("total"), F.lit(1).alias("profile_version")).withColumn("run_id", F.lit("run1"))
    stats = clean.groupBy("entity_key").agg(
        F.count("*").alias("total"), F.count_if(F.col("ts") >= F.expr(CUT)).alias("fresh"), F.max("ts").alias("last"))
    seen = stats.where("last >= TIMESTAMP '1999-06-01'")
    new = seen.where("fresh >= 3").select("entity_key", "total", F.lit(2).alias("profile_version"))
    return prev, new, seen.where("fresh < 3").select("entity_key")


@query("s12_publish_profiles", with_(*PROFILE_BASE, PREVNEW) + """SELECT entity_key, total, profile_version, 'run2' AS run_id FROM nw WHERE changed AND seen
UNION ALL SELECT p.entity_key, p.total, p.profile_version, 'run2' FROM pv p JOIN nw USING (entity_key) WHERE NOT changed AND seen""")
def s12(spark, d):
    prev, new, touched = publish_inputs(spark, d)
    return K.publish_profiles(prev, new, touched, "run2", prune=True)


@query("s12_stored_profiles", with_(*PROFILE_BASE, PREVNEW) + """SELECT entity_key, total, profile_version, 'run2' AS run_id FROM nw WHERE changed AND seen
UNION ALL SELECT p.entity_key, p.total, p.profile_version, 'run2' FROM pv p JOIN nw USING (entity_key) WHERE NOT changed AND seen
UNION ALL SELECT entity_key, total, profile_version, 'run1' FROM pv WHERE entity_key NOT IN (SELECT entity_key FROM nw WHERE seen)""")
def s12_stored(spark, d):
    """Two runs publish to one table, the second without pruning."""
    path = scratch(spark, "store")
    prev, new, touched = publish_inputs(spark, d)
    T.store_profiles(spark, path, "run1", prev.drop("run_id"), prev.where("false"))
    T.store_profiles(spark, path, "run2", new, touched, prune=False)
    return T.current_profiles(spark, path).select("entity_key", "total", "profile_version", "run_id")


@query("j04_stale_profiles", with_(*PROFILE_BASE, PREVNEW) + "SELECT entity_key FROM pv WHERE entity_key NOT IN (SELECT entity_key FROM nw WHERE seen)")
def j04_stale(spark, d):
    prev, new, touched = publish_inputs(spark, d)
    return K.stale(prev, new.select("entity_key").unionByName(touched)).select("entity_key")


@query("s13_history_snapshot", with_(*PROFILE_BASE) + f"""SELECT 'run1' AS run_id, entity_key, count(*) AS total_tx_count, {dsum()} AS total_tx_amount FROM clean WHERE ts < {CUT} GROUP BY 2
UNION ALL SELECT 'run2', entity_key, count(*), {dsum()} FROM clean GROUP BY 2""")
def s13(spark, d):
    path = scratch(spark, "history")
    clean = clean_rows(spark, d)
    for run, rows in (("run1", earlier(clean)), ("run2", clean)):
        profiles = rows.groupBy("entity_key").agg(F.count("*").alias("total_tx_count"), exact_sum("amount").alias("total_tx_amount"))
        K.append_history(profiles.withColumn("profile_version", F.lit(1)), run, path, full=True)
    return K.read_history(spark, path).select("run_id", "entity_key", "total_tx_count", "total_tx_amount")


@query("s14_run_lineage", with_(*PROFILE_BASE) + "SELECT 'run1' AS run_id, min(ts) AS window_start, max(ts) AS window_end, count(*) AS source_rows, count(DISTINCT entity_key) AS entities, 'done' AS status FROM clean")
def s14(spark, d):
    clean = clean_rows(spark, d)
    return K.run_lineage(clean, clean.select("entity_key").distinct(), "run1")


LOGROWS = """lg AS (SELECT event_id, CAST(ts AS DATE) AS day, event_type AS status, value AS risk_score, CASE WHEN event_type = 'error' THEN 'unavailable' ELSE 'coordinates' END AS geo_source,
  CASE WHEN event_type = 'click' THEN value * 10 END AS kmh FROM events)"""


@query("s15_inference_log", with_(LOGROWS) + "SELECT CAST(event_id AS VARCHAR) AS transaction_id, CAST(day AS VARCHAR) AS day, status, risk_score, geo_source, kmh FROM lg")
def s15(spark, d):
    path = scratch(spark, "log")
    for _ in range(2):  # the second time stands for a repeated run
        J.write_inference_log(J.log_rows(event_stream_table(spark, d)), path, "run1")
    return J.read_inference_log(spark, path).select("transaction_id", F.col("day").cast("string").alias("day"), "status", "risk_score", F.col("geo.geo_source").alias("geo_source"), F.col("geo.geo_velocity_kmh").alias("kmh"))


@query("s16_parquet_scan", "SELECT event_id, ts, user_id, event_type, value FROM events")
def s16(spark, d):
    return load(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")


@query("s17_event_trail", "SELECT CAST(user_id AS VARCHAR) AS entity_key, 'score' AS event_type, event_type AS outcome, concat('{\"amount\":', CASE WHEN value = floor(value) THEN concat(CAST(value AS BIGINT), '.0') ELSE CAST(value AS VARCHAR) END, '}') AS detail FROM events")
def s17(spark, d):
    path = scratch(spark, "trail")
    rows = event_stream_table(spark, d).select(F.col("customer_key").alias("entity_key"), F.lit(None).cast("string").alias("transaction_id"), "ts", F.col("category").alias("outcome"), F.struct("amount").alias("detail"))
    for _ in range(2):  # the second time stands for a repeated run
        K.append_events(rows, "score", path, "run1")
    return spark.read.parquet(path).select("entity_key", "event_type", "outcome", "detail")


@query("x26_json_maps", with_(*PROFILE_BASE) + """, h AS (SELECT entity_key, merchant_name AS b, count(*) AS n FROM clean GROUP BY 1, 2) SELECT entity_key, string_agg(concat(b, '=', n), ',' ORDER BY b) AS merchants, 0 AS broken FROM h GROUP BY 1""")
def x26(spark, d):
    counts = clean_rows(spark, d).groupBy("entity_key", "merchant_name").agg(F.count("*").alias("n")).groupBy("entity_key").agg(
        F.map_from_entries(F.collect_list(F.struct("merchant_name", "n"))).alias("m"))
    text = counts.withColumn("j", map_to_json("m"))
    return text.select("entity_key", map_text(json_to_map("j")).alias("merchants"), F.size(json_to_map(F.lit("{oops"))).alias("broken"))


# --- governance ---------------------------------------------------------------------------------------------------------

SETTINGS = """g AS (SELECT * FROM (VALUES ('velocity', '{"limit":"5","window":"60"}', 1), ('amount', '{"max":"1000"}', 1), ('night', '{}', 0)) t(rule_code, params, enabled)),
o AS (SELECT n_nationkey AS branch_id, r AS rule_code, CASE WHEN n_regionkey = 0 THEN {'limit': '9'} END AS p, CASE WHEN n_regionkey = 1 THEN 0 WHEN n_regionkey = 2 THEN 1 END AS enabled
  FROM nation, (VALUES ('velocity'), ('night')) v(r) WHERE n_regionkey <= 2)"""


@query("j10_effective_settings", with_(SETTINGS) + """SELECT n_nationkey AS branch_id, g.rule_code, coalesce(o.enabled, g.enabled) AS enabled, CASE g.rule_code WHEN 'velocity' THEN CASE WHEN o.p IS NOT NULL THEN 'limit=9,window=60' ELSE 'limit=5,window=60' END
  WHEN 'amount' THEN 'max=1000' ELSE CASE WHEN o.p IS NOT NULL THEN 'limit=9' ELSE '' END END AS params FROM nation, g LEFT JOIN o ON o.branch_id = n_nationkey AND o.rule_code = g.rule_code""")
def j10(spark, d):
    defaults = spark.createDataFrame([("velocity", {"limit": "5", "window": "60"}, 1), ("amount", {"max": "1000"}, 1), ("night", {}, 0)], "rule_code string, params map<string,string>, enabled int")
    nation = load(spark, d, "nation")
    overrides = nation.where("n_regionkey <= 2").select(
        F.col("n_nationkey").alias("branch_id"), F.explode(F.array(F.lit("velocity"), F.lit("night"))).alias("rule_code"),
        F.when(F.col("n_regionkey") == 0, F.create_map(F.lit("limit"), F.lit("9"))).alias("params"),
        F.expr("CASE n_regionkey WHEN 1 THEN 0 WHEN 2 THEN 1 END").alias("enabled"))
    return V.effective_settings(defaults, overrides, nation.select(F.col("n_nationkey").alias("branch_id"))).select("branch_id", "rule_code", "enabled", map_text("params").alias("params"))


PROF = """prof AS (SELECT entity_key, 'Customer ' || entity_key AS customer_name, count(*) AS total_tx_count, CASE WHEN count(*) >= 15 THEN 'active' ELSE 'warming_up' END AS profile_status,
  CAST(count(*) * 2 + 10 AS INTEGER) AS confidence_score, (epoch_us(max(ts)) - epoch_us(min(ts))) // 86400000000 AS tenure_days, count(*) AS lifetime_clean_txns, count(*) FILTER (WHERE destination_account_no IS NULL) AS suspicious_tx_count,
  max(branch_id) AS branch_id, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_amount, max(amount) AS max_amount, max(ts) AS last_seen, any_value(origin_account_no) AS account FROM clean GROUP BY 1)"""
CFG = Settings(min_tenure_days=800, min_clean_txns=25, max_fraud_txns=1, trust_confidence=60)


def small_profiles(clean):
    """Profiles with just the governance fields, from the same rows as the full ones."""
    return clean.groupBy("entity_key").agg(
        F.count("*").alias("total_tx_count"), F.floor(F.expr("(unix_micros(max(ts)) - unix_micros(min(ts))) / 86400000000D")).alias("tenure_days"),
        F.count_if(F.col("destination_account_no").isNull()).alias("suspicious_tx_count"), F.max("branch_id").alias("branch_id"),
        (exact_sum("amount") / F.count("*")).alias("avg_amount"), F.max("amount").alias("max_amount"), F.max("ts").alias("last_seen"),
        F.max("origin_account_no").alias("origin_account_no")).withColumns({
            "customer_name": F.concat(F.lit("Customer "), "entity_key"), "lifetime_clean_txns": F.col("total_tx_count"),
            "profile_status": F.when(F.col("total_tx_count") >= 15, "active").otherwise("warming_up"),
            "confidence_score": (F.col("total_tx_count") * 2 + 10).cast("int")})


TRUST = """CASE WHEN profile_status <> 'active' THEN concat('peer_baseline (', profile_status, ')') WHEN confidence_score < 60 THEN concat('peer_baseline (low confidence ', confidence_score, ')')
  WHEN suspicious_tx_count > 1 THEN concat('peer_baseline (§1 confirmed fraud: ', suspicious_tx_count, ' txn(s))') WHEN tenure_days < 800 THEN concat('peer_baseline (§1 tenure ', tenure_days, 'd < 800d)')
  WHEN lifetime_clean_txns < 25 THEN concat('peer_baseline (§1 clean txns ', lifetime_clean_txns, ' < 25)') ELSE 'own_profile' END"""


@query("f09_trust_gate", with_(*PROFILE_BASE, PROF) + f"SELECT entity_key, {TRUST} = 'own_profile' AS trusted, {TRUST} AS trust_reason FROM prof")
def f09(spark, d):
    return V.trust_gate(small_profiles(clean_rows(spark, d)), CFG).select("entity_key", "trusted", "trust_reason")


COUNTERS = """cc AS (SELECT entity_key, CASE WHEN extract(year FROM ts) % 2 = 0 THEN 'USD' ELSE 'NGN' END AS currency, count(*) AS txns_since_build, count(*) FILTER (WHERE hour(ts) < 6) AS drift_signal_count, max(ts) AS last_retrained_at FROM clean GROUP BY 1, 2)"""


def counters(clean):
    return clean.groupBy("entity_key", F.when(F.year("ts") % 2 == 0, "USD").otherwise("NGN").alias("currency")).agg(
        F.count("*").alias("txns_since_build"), F.count_if(F.hour("ts") < 6).alias("drift_signal_count"), F.max("ts").alias("last_retrained_at"))


@query("a22_retrain_counters", with_(*PROFILE_BASE, COUNTERS) + "SELECT entity_key, max(txns_since_build) AS new_txns, max(drift_signal_count) AS drift_signals, min(last_retrained_at) AS oldest, count(*) AS profiles FROM cc GROUP BY 1")
def a22(spark, d):
    return V.retrain_counters(counters(clean_rows(spark, d)))


DUE = Settings(retrain_min_new=25, retrain_max_age_days=500, drift_signals=8)


@query("x17_retrain_due", with_(*PROFILE_BASE, COUNTERS) + """, k AS (SELECT entity_key, max(txns_since_build) AS nt, max(drift_signal_count) AS dr, (epoch_us((SELECT max(ts) FROM clean)) - epoch_us(min(last_retrained_at))) // 86400000000 AS ds FROM cc GROUP BY 1)
SELECT entity_key, nt >= 25 OR ds >= 500 OR dr >= 8 AS due, CASE WHEN nt >= 25 THEN 'new_transactions' WHEN ds >= 500 THEN 'days_since_build' WHEN dr >= 8 THEN 'drift_signals' END AS trigger,
  greatest(25 - nt, 0) AS txns_to_go, greatest(500 - ds, 0) AS days_to_go, greatest(8 - dr, 0) AS signals_to_go FROM k""")
def x17(spark, d):
    clean = clean_rows(spark, d)
    return V.retrain_due(V.retrain_counters(counters(clean)), P.newest(clean), DUE).select("entity_key", "due", "trigger", "txns_to_go", "days_to_go", "signals_to_go")


@query("a23_rebuild_worklist", with_(TXN) + f"SELECT entity_key, count(*) AS n FROM txn WHERE ts >= {ASOF} - INTERVAL 12 MONTH GROUP BY 1 HAVING count(*) >= 5")
def a23(spark, d):
    txn = transactions(spark, d)
    return V.rebuild_worklist(txn, newest(txn), min_rows=5, months=12)


@query("a24_empty_diagnosis", with_(TXN) + f"""SELECT entity_key, CASE WHEN count(*) FILTER (WHERE ts >= {ASOF} - INTERVAL 12 MONTH) = 0 THEN 'customer_not_in_cache'
  WHEN count(*) FILTER (WHERE ts >= {ASOF} - INTERVAL 12 MONTH AND status = 'clean' AND NOT is_blocked AND NOT sender_blacklisted) = 0 THEN 'all_cached_txns_excluded' ELSE 'has_clean_history' END AS reason,
  count(*) FILTER (WHERE ts >= {ASOF} - INTERVAL 12 MONTH) AS rows_in_window FROM txn GROUP BY 1""")
def a24(spark, d):
    txn = transactions(spark, d)
    return V.diagnose_empty(txn, txn.select("entity_key").distinct(), newest(txn), 12).select("entity_key", "reason", "rows_in_window")


HIST = f"""hs AS (SELECT 'run1' AS run_id, entity_key, 1 AS profile_version, count(*) AS total_tx_count, max(ts) AS snapshot_ts FROM clean WHERE ts < {CUT} GROUP BY 2
  UNION ALL SELECT 'run2', entity_key, 2, count(*), max(ts) FROM clean GROUP BY 2)"""


def histories(clean):
    parts = [rows.groupBy("entity_key").agg(F.count("*").alias("total_tx_count"), F.max("ts").alias("snapshot_ts")).withColumns(
        {"run_id": F.lit(run), "profile_version": F.lit(v)}) for run, v, rows in (("run1", 1, earlier(clean)), ("run2", 2, clean))]
    return parts[0].unionByName(parts[1])


@query("o07_profile_rollback", with_(*PROFILE_BASE, HIST) + """SELECT c.entity_key, coalesce(p.total_tx_count, c.total_tx_count) AS total_tx_count, coalesce(p.profile_version, c.profile_version) AS profile_version,
  CASE WHEN p.entity_key IS NOT NULL THEN 'rolled_back' END AS retrain_reason FROM hs c LEFT JOIN hs p ON p.entity_key = c.entity_key AND p.run_id = 'run1' WHERE c.run_id = 'run2'""")
def o07(spark, d):
    history = histories(clean_rows(spark, d))
    current = history.where("run_id = 'run2'").drop("run_id", "snapshot_ts").withColumn("retrain_reason", F.lit(None).cast("string"))
    return V.rollback(current, history, F.col("run_id") == "run1", ["total_tx_count"])


# the first run stored whole profiles of entities with an even number of transactions, under a schema without n_days; of others, scalars
FULL = f"""a AS (SELECT entity_key, count(*) AS total_tx_count, {dsum()} AS total_tx_amount, list_sort(list(DISTINCT lower(trim(transaction_type)))) AS types FROM clean WHERE ts < {CUT} GROUP BY 1),
b AS (SELECT entity_key, count(*) AS total_tx_count, {dsum()} AS total_tx_amount, list_sort(list(DISTINCT lower(trim(transaction_type)))) AS types, count(DISTINCT CAST(ts AS DATE)) AS n_days FROM clean GROUP BY 1)"""


@query("o07_full_restore", with_(*PROFILE_BASE, FULL) + """SELECT b.entity_key, coalesce(a.total_tx_count, b.total_tx_count) AS total_tx_count, coalesce(a.total_tx_amount, b.total_tx_amount) AS total_tx_amount,
  array_to_string(CASE WHEN a.total_tx_count % 2 = 0 THEN a.types ELSE b.types END, ',') AS types, b.n_days, CASE WHEN a.entity_key IS NULL THEN 2 ELSE 1 END AS profile_version,
  CASE WHEN a.total_tx_count % 2 = 1 THEN 'rolled_back' END AS retrain_reason, CASE a.total_tx_count % 2 WHEN 0 THEN 'full' WHEN 1 THEN 'scalars' END AS restored FROM b LEFT JOIN a USING (entity_key)""")
def o07_full(spark, d):
    path = scratch(spark, "history")
    clean = clean_rows(spark, d)

    def profiles(rows, version):
        kinds = F.array_sort(F.collect_set(F.lower(F.trim("transaction_type"))))  # a handful of types
        return rows.groupBy("entity_key").agg(F.count("*").alias("total_tx_count"), exact_sum("amount").alias("total_tx_amount"), kinds.alias("types"),
                                              F.count_distinct(F.to_date("ts")).alias("n_days")).withColumn("profile_version", F.lit(version))

    old = profiles(earlier(clean), 1).drop("n_days")
    K.append_history(old.where("total_tx_count % 2 = 0"), "run1", path, full=True)
    K.append_history(old.where("total_tx_count % 2 = 1"), "run1b", path)
    history = K.read_history(spark, path).withColumn("snapshot_ts", F.lit(0))
    current = profiles(clean, 2).withColumn("retrain_reason", F.lit(None).cast("string"))
    schemas = {1: "entity_key string, total_tx_count long, total_tx_amount double, types array<string>"}
    out = V.restore(current, history, F.col("run_id").isin("run1", "run1b"), schemas, ("total_tx_count", "total_tx_amount"))
    return out.withColumn("types", F.array_join("types", ","))


@query("o08_profile_versions", with_(*PROFILE_BASE, HIST) + "SELECT entity_key, profile_version, run_id, total_tx_count, row_number() OVER (PARTITION BY entity_key ORDER BY snapshot_ts, profile_version) AS seq FROM hs")
def o08(spark, d):
    return V.versions(histories(clean_rows(spark, d))).select("entity_key", "profile_version", "run_id", "total_tx_count", "seq")


# one model a month of the transactions, judged on the month after; a clean row's anomaly is 2 to 10 times its amount
FACTOR = "2e0 + 8e0 * (id % 97) / 96e0"
MODELS = f"""lg AS (SELECT date_trunc('month', ts) AS month, ln(amount) AS x, bad, {FACTOR} AS factor FROM labelled),
ft AS (SELECT month, med AS centre, CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END AS spread, row_number() OVER (ORDER BY month) AS seq FROM
  (SELECT month, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.25) AS lo, quantile_cont(x, 0.75) AS hi FROM lg WHERE NOT bad GROUP BY 1)),
ct AS (SELECT month, quantile_cont(abs(x - centre) / spread, 0.95) AS cut FROM lg JOIN ft USING (month) WHERE NOT bad GROUP BY 1),
ju AS (SELECT strftime(a.month, '%Y-%m') AS version, a.seq, abs(x - a.centre) / a.spread AS d, abs(x + ln(factor) - a.centre) / a.spread AS s, bad, cut
  FROM ft a JOIN ct ON ct.month = a.month JOIN ft b ON b.seq = a.seq + 1 JOIN lg ON lg.month = b.month),
rk AS (SELECT version, y, rank() OVER (PARTITION BY version ORDER BY r) + (count(*) OVER (PARTITION BY version, r) - 1) / 2.0::DOUBLE AS k FROM
  (SELECT version, d AS r, 0 AS y FROM ju WHERE NOT bad UNION ALL SELECT version, s, 1 FROM ju WHERE NOT bad)),
au AS (SELECT version, (sum(k) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0))::DOUBLE AS auc FROM rk GROUP BY 1),
md AS (SELECT version, seq, auc AS synthetic_auc, n_rows, CASE WHEN flagged > 0 THEN tp / flagged::DOUBLE END AS precision, CASE WHEN bads > 0 THEN tp / bads::DOUBLE END AS recall, CASE WHEN flagged + bads > 0 THEN 2 * tp / (flagged + bads)::DOUBLE END AS f1 FROM
  (SELECT version, seq, count(*) AS n_rows, count(*) FILTER (WHERE bad AND d >= cut) AS tp, count(*) FILTER (WHERE d >= cut) AS flagged, count(*) FILTER (WHERE bad) AS bads FROM ju GROUP BY 1, 2) LEFT JOIN au USING (version))"""
MODEL_SQL = (TXN, VALID, LABELLED, MODELS)


def manifests(spark, d):
    from habitus.plans.modelling import labelled

    rows = materialize(labelled(spark, d).select("ts", "amount", "bad", "id"), "labelled")
    return materialize(W.judge_months(rows, materialize(W.train_months(rows), "models"), F.expr(FACTOR)), "registry")


@query("m13_monthly_models", with_(*MODEL_SQL) + "SELECT version, seq, round(synthetic_auc, 9) AS synthetic_auc, n_rows, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM md")
def m13_models(spark, d):
    return manifests(spark, d).select("version", "seq", "n_rows", *[F.round(c, 9).alias(c) for c in ("synthetic_auc", "precision", "recall", "f1")])


@query("m13_promotion_gate", with_(*MODEL_SQL) + """SELECT version, round(lag(best) OVER (ORDER BY seq), 9) AS active_auc, synthetic_auc >= coalesce(lag(best) OVER (ORDER BY seq), 0) AS promoted FROM
  (SELECT *, max(synthetic_auc) OVER (ORDER BY seq) AS best FROM md)""")
def m13(spark, d):
    return V.promotion_history(manifests(spark, d)).select("version", F.round("active_auc", 9).alias("active_auc"), "promoted")


@query("o03_model_health", with_(*MODEL_SQL) + """SELECT version, coalesce(synthetic_auc >= 0.75, true) AND coalesce(precision >= 0.02, true) AS healthy, array_to_string(list_filter([CASE WHEN synthetic_auc < 0.75 THEN format('synthetic-anomaly AUC {:.3f} < floor 0.75', round(synthetic_auc, 3)) END,
  CASE WHEN precision < 0.02 THEN format('precision {:.3f} < floor 0.02', round(precision, 3)) END], lambda x: x IS NOT NULL), '; ') AS problems FROM md""")
def o03(spark, d):
    return V.health(manifests(spark, d)).select("version", "healthy", F.array_join("problems", "; ").alias("problems"))


@query("o09_performance_history", with_(*MODEL_SQL) + """SELECT version, round(synthetic_auc - lag(synthetic_auc) OVER (ORDER BY seq), 9) AS auc_change, round(avg(synthetic_auc) OVER (ORDER BY seq ROWS 4 PRECEDING), 9) AS auc_trend FROM md""")
def o09(spark, d):
    return V.performance_history(manifests(spark, d)).select("version", F.round("auc_change", 9).alias("auc_change"), F.round("auc_trend", 9).alias("auc_trend"))


# what a customer's model would have seen as transaction types, in order of their first day, against the order of all customers
@query("m15_schema_guard", with_(TXN) + """, o AS (SELECT lower(trim(transaction_type)) AS t, row_number() OVER (ORDER BY CAST(min(ts) AS DATE), lower(trim(transaction_type))) AS i FROM txn GROUP BY 1),
g AS (SELECT list(t ORDER BY i) AS running FROM o), c AS (SELECT customer_key, list(t ORDER BY f, i) AS stored FROM (SELECT customer_key, lower(trim(transaction_type)) AS t, CAST(min(ts) AS DATE) AS f FROM txn GROUP BY 1, 2) JOIN o USING (t) GROUP BY 1)
SELECT customer_key, CASE WHEN stored = running THEN 'equal' WHEN stored = running[1:len(stored)] THEN 'prefix' ELSE 'mismatch' END AS state FROM c, g""")
def m15(spark, d):
    rows = transactions(spark, d).select("customer_key", F.lower(F.trim("transaction_type")).alias("t"), F.to_date("ts").alias("day"))
    running = [r["t"] for r in rows.groupBy("t").agg(F.min("day").alias("f")).orderBy("f", "t").collect()]  # a handful of types
    place = F.array_position(F.array(*map(F.lit, running)), F.col("t"))
    first = rows.groupBy("customer_key", "t").agg(F.min("day").alias("f"))
    stored = first.groupBy("customer_key").agg(F.array_sort(F.collect_list(F.struct("f", place.alias("i"), "t"))).alias("s"))
    return stored.select("customer_key", V.schema_state(F.col("s.t"), running).alias("state"))
