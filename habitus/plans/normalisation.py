"""Queries of the normalisation and filter operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from habitus.functions import normalize as N
from habitus.operators import filters as L
from habitus.plans.ctes import CLEAN, ELIGIBLE, LABELLED, SANE, TRAIN, TXN, UNIQ, VALID, with_
from habitus.plans.registry import query
from habitus.sources.tables import event_stream_table, load, transactions
from habitus.config import DEFAULTS, Settings

FIXTURE_ML = {"min_txns": 20, "min_days": 30}


@query("p01_entity_key", with_(TXN) + "SELECT transaction_id, version, concat(branch_id, ':', origin_account_no) AS entity_key FROM txn")
def p01(spark, d):
    return transactions(spark, d).select("transaction_id", "version", N.entity_key("branch_id", "origin_account_no").alias("entity_key"))


@query("p02_currency", with_(TXN) + """
SELECT transaction_id, version, CASE WHEN currency IS NULL OR trim(currency) = '' THEN 'NGN'
  WHEN upper(trim(currency)) = 'NAIRA' THEN 'NGN' WHEN upper(trim(currency)) = 'POUND' THEN 'GBP'
  WHEN upper(trim(currency)) = 'EURO' THEN 'EUR' ELSE upper(trim(currency)) END AS currency FROM txn""")
def p02(spark, d):
    return transactions(spark, d).select("transaction_id", "version", N.normalize_currency("currency").alias("currency"))


@query("p03_transaction_type", with_(TXN) + "SELECT trim(lower(coalesce(transaction_type, ''))) AS txn_type, count(*) AS n FROM txn GROUP BY 1")
def p03(spark, d):
    return transactions(spark, d).groupBy(N.canonical_type("transaction_type").alias("txn_type")).agg(F.count("*").alias("n"))


@query("p04_account_type", with_(TXN) + """SELECT coalesce(account_type, 'unknown') AS peer_type,
  CASE WHEN account_type = 'corporate' THEN 'corporate' ELSE 'individual' END AS request_type, count(*) AS n FROM txn GROUP BY 1, 2""")
def p04(spark, d):
    return transactions(spark, d).groupBy(
        N.account_type("account_type").alias("peer_type"), N.account_type("account_type", "request").alias("request_type"),
    ).agg(F.count("*").alias("n"))


@query("p05_boolish", """SELECT l_returnflag AS raw, CASE l_returnflag WHEN 'R' THEN 'T' WHEN 'A' THEN NULL ELSE 'false' END AS txt,
  CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN NULL ELSE false END AS flag, count(*) AS n FROM lineitem GROUP BY 1, 2, 3""")
def p05(spark, d):
    txt = F.when(F.col("l_returnflag") == "R", "T").when(F.col("l_returnflag") != "A", "false")
    return load(spark, d, "lineitem").select(F.col("l_returnflag").alias("raw"), txt.alias("txt")).groupBy(
        "raw", "txt", N.boolish("txt").alias("flag")).agg(F.count("*").alias("n"))


@query("p06_city", with_(TXN) + """SELECT transaction_id, version, trim(CASE WHEN len(string_split(customer_location, ',')) >= 2
  THEN string_split(customer_location, ',')[2] ELSE string_split(customer_location, ',')[1] END) AS city FROM txn""")
def p06(spark, d):
    return transactions(spark, d).select("transaction_id", "version", N.city_of("customer_location").alias("city"))


@query("p07_subnet_loose", with_(TXN) + r"SELECT transaction_id, version, regexp_replace(customer_ip_address, '\.\d+$', '.0/24') AS subnet FROM txn")
def p07(spark, d):
    return transactions(spark, d).select("transaction_id", "version", N.ip_subnet_loose("customer_ip_address").alias("subnet"))


@query("p08_subnet_strict", with_(TXN) + """, ip AS (SELECT transaction_id, version, string_split(customer_ip_address, '.') AS p FROM txn)
SELECT transaction_id, version, CASE WHEN len(p) = 4 THEN concat(p[1], '.', p[2], '.', p[3], '.0/24') END AS subnet FROM ip""")
def p08(spark, d):
    return transactions(spark, d).select("transaction_id", "version", N.ip_subnet_strict("customer_ip_address").alias("subnet"))


@query("p09_location", with_(TXN) + "SELECT nullif(lower(trim(customer_location)), '') AS location, count(*) AS n FROM txn GROUP BY 1")
def p09(spark, d):
    return transactions(spark, d).groupBy(N.canonical_location("customer_location").alias("location")).agg(F.count("*").alias("n"))


@query("p10_time_parts", with_(TXN) + """, m AS (SELECT max(ts) AS as_of FROM txn)
SELECT transaction_id, version, hour(ts) AS hour, isodow(ts) AS iso_dow, isodow(ts) - 1 AS dow, hour(ts) < 6 AS is_night,
  (epoch_us(as_of) - epoch_us(ts)) / 86400000000.0::DOUBLE AS age_days, in_d <= 1 AS in_24h, in_d <= 7 AS in_7d, in_d <= 30 AS in_30d,
  in_d <= 60 AS in_60d, in_d <= 90 AS in_90d
FROM (SELECT *, (epoch_us(as_of) - epoch_us(ts)) / 86400000000.0::DOUBLE AS in_d FROM txn, m)""")
def p10(spark, d):
    txn = transactions(spark, d)
    as_of = txn.agg(F.max("ts")).scalar()
    return N.with_time_parts(txn, as_of).select(
        "transaction_id", "version", "hour", "iso_dow", "dow", "is_night", "age_days", *N.WINDOW_DAYS)


@query("p11_decay_weight", with_(TXN) + """, m AS (SELECT max(ts) AS as_of FROM txn)
SELECT transaction_id, version, round(pow(0.5::DOUBLE, greatest((epoch_us(as_of) - epoch_us(ts)) / 86400000000.0::DOUBLE, 0) / 90.0::DOUBLE), 9) AS weight FROM txn, m""")
def p11(spark, d):
    txn = transactions(spark, d)
    age = N.days_between(txn.agg(F.max("ts")).scalar(), "ts")
    return txn.select("transaction_id", "version", F.round(N.decay_weight(age, 90.0), 9).alias("weight"))


@query("p13_request_validation", with_(TXN) + """, req AS (SELECT transaction_id, version, amount, upper(trim(currency)) AS ccy,
    lower(trim(transaction_type)) AS tt, account_type, customer_email, customer_name FROM txn),
flags AS (SELECT *, list_filter([CASE WHEN NOT coalesce(amount > 0 AND amount <= 1e15, false) THEN 'amount' END,
    CASE WHEN NOT coalesce(regexp_full_match(ccy, '[A-Z]{3}'), false) THEN 'currency' END,
    CASE WHEN NOT coalesce(length(tt) BETWEEN 1 AND 60, false) THEN 'transaction_type' END,
    CASE WHEN NOT coalesce(regexp_full_match(trim(customer_email), '[^@\\s]+@[^@\\s]+\\.[^@\\s]+'), false) THEN 'customer_email' END,
    CASE WHEN NOT coalesce(lower(trim(account_type)) IN ('individual', 'corporate'), false) THEN 'account_type' END,
    CASE WHEN NOT coalesce(length(customer_name) BETWEEN 1 AND 200, false) THEN 'customer_name' END], lambda x: x IS NOT NULL) AS r FROM req)
SELECT transaction_id, version, len(r) = 0 AS accepted, array_to_string(r, ',') AS reasons FROM flags""")
def p13(spark, d):
    from habitus.sources.requests import with_reject_reasons
    return with_reject_reasons(transactions(spark, d)).select(
        "transaction_id", "version", (F.size("reasons") == 0).alias("accepted"), F.array_join("reasons", ",").alias("reasons"))


@query("p12_flatten_payload", with_(TXN) + """SELECT coalesce(bvn, 'unknown') AS customer_key, transaction_id, amount, transaction_type, ts, customer_ip_address,
  customer_location, origin_country, destination_country, destination_account_no, CAST(NULL AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude
FROM txn WHERE amount > 0""")
def p12(spark, d):
    from habitus.sources.requests import flatten_payload, payload_json
    return flatten_payload(payload_json(transactions(spark, d)), "payload")


@query("p14_coordinates", """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN value BETWEEN -90 AND 90 THEN value END AS lat FROM events""")
def p14(spark, d):
    raw = F.when(F.col("category") == "error", "n/a").otherwise(F.col("amount").cast("string"))
    return event_stream_table(spark, d).select("event_id", N.coordinate(raw, -90.0, 90.0).alias("lat"))


@query("p15_masked_ref", "SELECT c_custkey, CASE WHEN c_acctbal < 9000 THEN concat('id:***', right(lpad(CAST(c_custkey AS VARCHAR), 9, '0'), 4)) ELSE 'id:unknown' END AS ref FROM customer")
def p15(spark, d):
    bvn = F.expr("CASE WHEN c_acctbal < 9000 THEN lpad(cast(c_custkey AS string), 9, '0') END")
    return load(spark, d, "customer").select("c_custkey", N.mask_ref(bvn).alias("ref"))


@query("p16_verdict", """SELECT l_returnflag, l_linestatus, CASE WHEN l_returnflag = 'R' THEN 'fraud' WHEN l_returnflag = 'A' THEN 'genuine' END AS verdict,
  count(*) AS n FROM lineitem GROUP BY 1, 2, 3""")
def p16(spark, d):
    word = F.expr("CASE l_returnflag WHEN 'R' THEN ' Confirmed_Fraud' WHEN 'A' THEN 'Legit ' ELSE 'maybe' END")
    return load(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus", N.canonical_verdict(word).alias("verdict")).agg(F.count("*").alias("n"))


@query("p17_stable_key", with_(TXN) + "SELECT transaction_id, version, coalesce(bvn, destination_account_no, transaction_id) AS stable_key FROM txn")
def p17(spark, d):
    return transactions(spark, d).select("transaction_id", "version", N.stable_key("bvn", "destination_account_no", "transaction_id").alias("stable_key"))


@query("f01_usable_key", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'N/A' WHEN o_orderstatus = 'O' THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS account
FROM orders WHERE o_orderstatus NOT IN ('F', 'O')""")
def f01(spark, d):
    acct = F.expr("CASE o_orderstatus WHEN 'F' THEN 'N/A' WHEN 'O' THEN '' ELSE cast(o_custkey AS string) END")
    return L.usable_key(load(spark, d, "orders").select("o_orderkey", acct.alias("account")), "account")


@query("f02_sane_amount", with_(TXN, SANE) + "SELECT transaction_id, version, amount FROM sane")
def f02(spark, d):
    return L.sane_amount(transactions(spark, d)).select("transaction_id", "version", "amount")


@query("f03_strict_clean", with_(TXN) + "SELECT transaction_id, version FROM txn WHERE status = 'clean' AND NOT is_blocked AND NOT sender_blacklisted")
def f03(spark, d):
    return L.strict_clean(transactions(spark, d)).select("transaction_id", "version")


@query("f04_weak_label", with_(TXN) + """SELECT transaction_id, version, (coalesce(status <> 'clean', false) OR is_blocked OR sender_blacklisted) AS bad FROM txn""")
def f04(spark, d):
    return transactions(spark, d).select("transaction_id", "version", L.weak_bad().alias("bad"))


@query("f05_validation_report", with_(TXN, VALID) + """SELECT (SELECT count(*) FROM txn) AS rows_in,
  (SELECT count(*) FROM txn WHERE NOT (amount > 0 AND amount <= 1e13)) AS dropped_bad_amount,
  (SELECT count(*) FROM txn WHERE ts IS NULL) AS dropped_bad_timestamp,
  (SELECT count(*) FROM txn WHERE coalesce(customer_key, '') = '') AS dropped_no_customer_key,
  (SELECT count(*) - count(DISTINCT transaction_id) FROM txn) AS dropped_duplicate_txn_id,
  (SELECT count(*) FROM valid) AS rows_out, (SELECT count(DISTINCT customer_key) FROM valid) AS distinct_customers""")
def f05(spark, d):
    return L.validation_report(transactions(spark, d))


@query("f06_dedup", with_(TXN, SANE, UNIQ) + "SELECT branch_id, transaction_id, version, amount FROM uniq")
def f06(spark, d):
    return L.dedup(L.sane_amount(transactions(spark, d)), ["branch_id", "transaction_id"]).select(
        "branch_id", "transaction_id", "version", "amount")


@query("f08_ml_eligibility", with_(TXN, VALID, LABELLED) + """SELECT customer_key, count(*) AS txns, (epoch_us(max(ts)) - epoch_us(min(ts))) // 86400000000 AS span_days,
  count(*) >= 20 AS enough_txns, (epoch_us(max(ts)) - epoch_us(min(ts))) // 86400000000 >= 30 AS enough_days,
  count(*) >= 20 AND (epoch_us(max(ts)) - epoch_us(min(ts))) // 86400000000 >= 30 AS eligible FROM labelled WHERE NOT bad GROUP BY customer_key""")
def f08(spark, d):
    return L.ml_eligible(L.validate(transactions(spark, d)).where(~L.weak_bad()), **FIXTURE_ML)


@query("j03_only_eligible", with_(TXN, VALID, LABELLED, ELIGIBLE, TRAIN) + "SELECT customer_key, transaction_id, amount FROM train")
def j03(spark, d):
    clean = L.validate(transactions(spark, d)).where(~L.weak_bad())
    return L.only_eligible(clean, L.ml_eligible(clean, **FIXTURE_ML)).select("customer_key", "transaction_id", "amount")


VERDICTS = """verdicts AS (SELECT DISTINCT concat(l_orderkey, '-', l_linenumber) AS transaction_id,
  CASE WHEN l_linenumber <= 3 THEN 'Genuine' WHEN l_linenumber = 4 THEN 'unsure' ELSE ' fraud' END AS verdict
  FROM lineitem WHERE l_quantity >= 48)"""


def verdicts(spark, d):
    """Analyst verdicts on large orders, one per transaction."""
    return load(spark, d, "lineitem").where("l_quantity >= 48").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("transaction_id"),
        F.expr("CASE WHEN l_linenumber <= 3 THEN 'Genuine' WHEN l_linenumber = 4 THEN 'unsure' ELSE ' fraud' END").alias("verdict"),
    ).distinct()


@query("j05_feedback_override", with_(TXN, VALID, LABELLED, VERDICTS) + """SELECT l.transaction_id, CASE lower(trim(v.verdict)) WHEN 'fraud' THEN true
  WHEN 'genuine' THEN false ELSE l.bad END AS bad FROM labelled l LEFT JOIN verdicts v ON l.transaction_id = v.transaction_id""")
def j05(spark, d):
    return L.apply_feedback(L.validate(transactions(spark, d)), verdicts(spark, d)).select("transaction_id", "bad")


@query("t05_distinct_rows", with_(TXN) + "SELECT DISTINCT identifier, customer_name, bvn FROM txn")
def t05(spark, d):
    return transactions(spark, d).select("identifier", "customer_name", "bvn").distinct()
