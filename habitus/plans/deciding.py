"""Queries of the decision and evaluation layers, on features and scores derived from the order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from habitus.config import CODES, DETECTOR_LABELS, FEATURES, SIGNAL_GROUPS, ZONES
from habitus.functions import scoring as S
from habitus.operators import evaluate as E
from habitus.plans.ctes import with_
from habitus.plans.registry import query
from habitus.sources.tables import load, spread

# One expression per column, in a dialect both engines read: a spread of values that crosses every rule's boundary.
H = "(({m} * (l_orderkey * 8 + l_linenumber) + l_partkey + l_suppkey) % 65537) / 65537e0"


def h(m: int) -> str:
    return f"({H.format(m=m)})"


PSEUDO = {
    "amt_log": f"ln(1 + l_extendedprice)", "amt_z": f"{h(331)} * 6 - 1", "amt_over_median": f"{h(337)} * 8", "amt_over_p95": f"{h(347)} * 3",
    "amt_over_max": f"CASE WHEN l_quantity = 7 THEN 1e0 ELSE {h(349)} * 1.25e0 END",
    "above_max": f"CASE WHEN l_quantity <> 7 AND {h(349)} * 1.25e0 > 1 THEN 1e0 ELSE 0e0 END",
    "hour_rarity": h(353), "dow_rarity": h(359), "is_night": f"CASE WHEN {h(367)} < 0.25e0 THEN 1e0 ELSE 0e0 END",
    "location_new": f"CASE WHEN {h(373)} < 0.2e0 THEN 1e0 ELSE 0e0 END", "country_new": f"CASE WHEN {h(379)} < 0.1e0 THEN 1e0 ELSE 0e0 END",
    "cross_border": f"CASE WHEN {h(383)} < 0.3e0 THEN 1e0 ELSE 0e0 END", "beneficiary_new": f"CASE WHEN {h(389)} < 0.3e0 THEN 1e0 ELSE 0e0 END",
    "type_rare": f"CASE WHEN {h(397)} < 0.1e0 THEN 1e0 ELSE 0e0 END", "ip_new": f"CASE WHEN {h(401)} < 0.2e0 THEN 1e0 ELSE 0e0 END",
    "vel_1m": f"CASE WHEN {h(409)} < 0.1e0 THEN ln(3e0) WHEN {h(409)} < 0.3e0 THEN ln(2e0) ELSE 0e0 END",
    "vel_2m": f"CASE WHEN {h(409)} < 0.3e0 THEN ln(2e0) ELSE 0e0 END", "vel_3m": f"CASE WHEN {h(409)} < 0.05e0 THEN ln(5e0) WHEN {h(409)} < 0.3e0 THEN ln(3e0) ELSE 0e0 END",
    "vel_10m": f"CASE WHEN {h(409)} < 0.4e0 THEN ln(4e0) ELSE 0e0 END", "vel_15m": f"CASE WHEN {h(409)} < 0.4e0 THEN ln(4e0) ELSE 0e0 END",
    "vel_1h": f"CASE WHEN {h(409)} < 0.5e0 THEN ln(5e0) ELSE 0e0 END", "vel_24h": f"CASE WHEN {h(409)} < 0.7e0 THEN ln(9e0) ELSE 0e0 END",
    "amt_1h_ratio": f"{h(419)} * 2.5e0", "recency_hours": f"{h(421)} * 720", "g_fanout": h(431), "g_distinct_benef": f"{h(433)} * 3", "g_shared_cp": f"{h(439)} * 3",
}
SCORES = {
    "isoforest": h(48271), "autoencoder": f"CASE WHEN l_linenumber = 6 THEN NULL ELSE {h(69621)} END",
    "gnn": f"CASE WHEN l_linenumber >= 6 THEN NULL ELSE {h(16807)} END",
}
COLD = "l_suppkey % 5 = 0"
LABEL = "CASE WHEN l_returnflag = 'R' AND l_discount >= 0.05e0 THEN 1 ELSE 0 END"
IDS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
FEATS = ("feats AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(f"{e} AS {n}" for n, e in {**PSEUDO, **SCORES}.items())
         + f", {COLD} AS is_cold_start, {LABEL} AS label FROM lineitem)")
KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def scored(spark, d):
    """Order lines as rows with features, detector scores, a weak label and a cold-start flag."""
    cols = {**PSEUDO, **SCORES}
    return spread(load(spark, d, "lineitem"), "l_orderkey").select(
        *KEYS, *[F.expr(e).cast("double").alias(n) for n, e in cols.items()], F.expr(COLD).alias("is_cold_start"), F.expr(LABEL).alias("label"))


def detectors() -> dict:
    return {k: F.col(k) for k in SCORES}


N_ = "(CASE WHEN isoforest IS NULL THEN 0 ELSE 1 END + CASE WHEN autoencoder IS NULL THEN 0 ELSE 1 END + CASE WHEN gnn IS NULL THEN 0 ELSE 1 END)"
MEAN_ = ("((coalesce(0.35e0 * isoforest, 0) + coalesce(0.35e0 * autoencoder, 0) + coalesce(0.30e0 * gnn, 0)) / "
         "(CASE WHEN isoforest IS NULL THEN 0e0 ELSE 0.35e0 END + CASE WHEN autoencoder IS NULL THEN 0e0 ELSE 0.35e0 END + CASE WHEN gnn IS NULL THEN 0e0 ELSE 0.30e0 END))")
RANK_ = "list_reverse_sort(list_filter([isoforest, autoencoder, gnn], lambda x: x IS NOT NULL))"
MODES = {
    "escalate": f"greatest({MEAN_}, {RANK_}[2])", "mean": MEAN_, "max": f"{RANK_}[1]",
    "noisy_or": "1 - (1 - isoforest) * (1 - coalesce(autoencoder, 0)) * (1 - coalesce(gnn, 0))",
}
RISK = f"risk AS (SELECT *, CASE WHEN {N_} = 1 THEN {MEAN_} ELSE {MODES['escalate']} END AS risk_score FROM feats)"


@query("x07_blend", with_(FEATS) + f"SELECT {IDS}, " + ", ".join(
    f"round(CASE WHEN {N_} = 1 THEN {MEAN_} ELSE {e} END, 9) AS risk_{m}" for m, e in MODES.items()) + " FROM feats")
def x07(spark, d):
    return scored(spark, d).select(*KEYS, *[F.round(S.blend(detectors(), mode=m)[0], 9).alias(f"risk_{m}") for m in MODES])


@query("x08_confidence", with_(FEATS, RISK) + f"""SELECT {IDS}, round(least(greatest(0.5 * (1 - least(list_stddev_pop(list_filter([isoforest, autoencoder, gnn], lambda x: x IS NOT NULL)) / 0.5, 1))
  + 0.5 * abs(risk_score - 0.5) * 2, 0.05), 0.99), 8) AS confidence_score FROM risk""")
def x08(spark, d):
    return scored(spark, d).select(*KEYS, F.round(S.blend(detectors())[1], 8).alias("confidence_score"))


CUTS = {"unsafe_high": 0.97, "unsafe": 0.9, "review": 0.75}
GROUP_MAX = {c: "greatest(" + ", ".join(f"abs({f})" for f in g) + ")" for c, g in SIGNAL_GROUPS}
PRIMARY = "CASE " + " ".join(f"WHEN {g} = greatest({', '.join(GROUP_MAX.values())}) THEN '{c}'" for c, g in GROUP_MAX.items()) + " END"
CODE = f"CASE WHEN risk_score >= 0.97e0 THEN 'BF-400' WHEN risk_score >= 0.9e0 THEN {PRIMARY} WHEN risk_score >= 0.75e0 THEN 'BF-200' WHEN risk_score < 0.5e0 THEN 'BF-110' ELSE 'BF-100' END"
DECIDED = f"decided AS (SELECT *, CASE WHEN activity_code IN ('BF-100', 'BF-110') THEN 'safe' WHEN activity_code = 'BF-200' THEN 'review' ELSE 'unsafe' END AS status FROM (SELECT *, {CODE} AS activity_code FROM risk))"


def decided(spark, d):
    df = scored(spark, d)
    return S.decide(df.withColumn("risk_score", S.blend(detectors())[0]), CUTS)


@query("x09_tier_decision", with_(FEATS, RISK, DECIDED) + f"""SELECT {IDS}, activity_code, status, CASE status WHEN 'safe' THEN 'clear_normal' WHEN 'review' THEN 'review_grey' ELSE 'priority_1_unsafe' END AS zone,
  CASE status WHEN 'safe' THEN 'bypass manual review' WHEN 'review' THEN 'secondary manual review' ELSE 'auto-block or priority analyst verification' END AS recommended_queue FROM decided""")
def x09(spark, d):
    return decided(spark, d).select(*KEYS, "activity_code", "status", "zone", "recommended_queue")


@query("x10_primary_signal", with_(FEATS) + f"SELECT {IDS}, {PRIMARY} AS code FROM feats")
def x10(spark, d):
    return scored(spark, d).select(*KEYS, S.primary_code().alias("code"))


BURST = "(vel_3m >= 1.39e0 OR vel_1m >= 1.10e0)"
VSMAX = "CASE WHEN above_max >= 1 THEN 'exceeds' WHEN amt_over_max >= 1 - 1e-6 THEN 'at' ELSE '' END"
RULES = {
    "amount_above_historical_max": f"{VSMAX} = 'exceeds'", "amount_at_historical_max": f"{VSMAX} = 'at'", "amount_far_above_usual": "amt_z >= 3 OR amt_over_median >= 5",
    "new_beneficiary": "beneficiary_new >= 1", "new_location": "location_new >= 1", "new_country": "country_new >= 1", "cross_border": "cross_border >= 1",
    "unusual_hour": "hour_rarity > 0.9e0", "night_time": "is_night >= 1", "unusual_day": "dow_rarity > 0.9e0", "velocity_burst": BURST,
    "recent_activity": f"NOT {BURST} AND (vel_1m > 0 OR vel_2m > 0 OR vel_3m > 0 OR vel_10m > 0 OR vel_15m > 0 OR vel_1h > 0)",
    "shared_counterparty": "g_shared_cp >= 2", "rare_transaction_type": "type_rare >= 1", "new_ip": "ip_new >= 1",
    "high_fanout": "g_fanout >= 0.9e0 AND g_distinct_benef >= 1.6e0", "hourly_amount_spike": "amt_1h_ratio >= 2",
}
SIGNALS = "list_filter([" + ", ".join(f"CASE WHEN {p} THEN '{c}' END" for c, p in RULES.items()) + "], lambda x: x IS NOT NULL)"
HIGH = ("list_transform(list_sort(list_filter([" + ", ".join(f"CASE WHEN {k} >= 0.85e0 THEN {{'v': -{k}, 'k': '{k}'}} END" for k in SCORES)
        + "], lambda x: x IS NOT NULL)), lambda x: x.k)")


@query("x11_triggered_signals", with_(FEATS) + f"SELECT {IDS}, array_to_string({SIGNALS}, ',') AS signals FROM feats")
def x11(spark, d):
    return scored(spark, d).select(*KEYS, F.array_join(S.triggered_signals(), ",").alias("signals"))


@query("x12_detection_reasons", with_(FEATS, RISK, DECIDED) + f"""SELECT {IDS}, CASE WHEN status = 'safe' THEN '' ELSE array_to_string(list_concat({SIGNALS}, list_transform({HIGH}, lambda x: concat('detector:', x)),
  CASE WHEN is_cold_start THEN ['cold_start'] ELSE [] END), ',') END AS signals,
  CASE WHEN status = 'safe' THEN 0 ELSE len({SIGNALS}) + len({HIGH}) + CASE WHEN is_cold_start THEN 1 ELSE 0 END END AS n_reasons,
  status <> 'safe' AND is_cold_start AND (amt_z >= 3 OR amt_over_median >= 5) AS cold_wording FROM decided""")
def x12(spark, d):
    out = S.explain(decided(spark, d), detectors())
    cold = F.array_contains("detection_reason", "transaction amount is far above the population baseline")
    return out.select(*KEYS, F.array_join("triggered_signals", ",").alias("signals"), F.size("detection_reason").alias("n_reasons"), cold.alias("cold_wording"))


@query("x13_narrative", with_(FEATS, RISK, DECIDED) + f"""SELECT {IDS}, status = 'safe' AS opens_safe, status <> 'safe' AND is_cold_start AS tells_cold_start,
  CASE WHEN amt_over_median >= 2 THEN true ELSE false END AS tells_times FROM decided""")
def x13(spark, d):
    out = decided(spark, d).withColumn("text", S.narrative(detectors()))
    return out.select(*KEYS, F.startswith("text", F.lit("Safe.")).alias("opens_safe"), F.contains("text", F.lit("customer is in cold-start")).alias("tells_cold_start"),
                      F.contains("text", F.lit("transaction amount is approximately")).alias("tells_times"))


@query("x14_amount_wording", with_(FEATS) + f"SELECT {IDS}, {VSMAX} AS wording FROM feats")
def x14(spark, d):
    return scored(spark, d).select(*KEYS, S.amount_vs_max().alias("wording"))


@query("m07_score_quantiles", with_(FEATS) + """, r AS (SELECT isoforest AS s, row_number() OVER (ORDER BY isoforest) - 1 AS pos, count(*) OVER () AS n FROM feats),
g AS (SELECT i, i / 1000.0::DOUBLE * ((SELECT any_value(n) FROM r) - 1) AS p FROM range(0, 1001) t(i))
SELECT i, round(lo.s + (hi.s - lo.s) * (p - floor(p)), 8) AS q FROM g JOIN r lo ON lo.pos = floor(p) JOIN r hi ON hi.pos = ceil(p)""")
def m07(spark, d):
    return E.fit_quantiles(scored(spark, d), "isoforest").select(F.posexplode("quantiles").alias("i", "q")).select("i", F.round("q", 8).alias("q"))


@query("x22_ecdf_lookup", with_(FEATS) + """, r AS (SELECT isoforest AS s, row_number() OVER (ORDER BY isoforest) - 1 AS pos, count(*) OVER () AS n FROM feats WHERE label = 0),
g AS (SELECT i, i / 1000.0::DOUBLE * ((SELECT any_value(n) FROM r) - 1) AS p FROM range(0, 1001) t(i)),
qs AS (SELECT list(lo.s + (hi.s - lo.s) * (p - floor(p)) ORDER BY i) AS q FROM g JOIN r lo ON lo.pos = floor(p) JOIN r hi ON hi.pos = ceil(p))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(len(list_filter(q, lambda x: x <= autoencoder)) / 1001.0::DOUBLE, 2) AS ecdf FROM feats, qs WHERE autoencoder IS NOT NULL""")
def x22(spark, d):
    df = scored(spark, d)
    q = E.fit_quantiles(df.where("label = 0"), "isoforest")
    rows = df.where("autoencoder IS NOT NULL").withColumn("q", q.scalar())
    return rows.select(*KEYS, F.round(S.ecdf_lookup(F.col("q"), F.col("autoencoder")), 2).alias("ecdf"))


@query("m08_tier_cuts", with_(FEATS, RISK) + "SELECT round(quantile_cont(risk_score, 0.999), 8) AS unsafe_high, round(quantile_cont(risk_score, 0.99), 8) AS unsafe, round(quantile_cont(risk_score, 0.95), 8) AS review FROM risk")
def m08(spark, d):
    cuts = E.fit_cuts(scored(spark, d).withColumn("risk_score", S.blend(detectors())[0]))
    return cuts.select(*[F.round(c, 8).alias(c) for c in cuts.columns])


@query("o04_threshold_zones", with_(FEATS, RISK) + """, c AS (SELECT quantile_cont(risk_score, 0.99) AS unsafe, quantile_cont(risk_score, 0.95) AS review FROM risk)
SELECT 'clear_normal' AS zone, 'safe' AS status, NULL::DOUBLE AS lower, round(review, 4) AS upper, 'bypass manual review' AS action FROM c
UNION ALL SELECT 'review_grey', 'review', round(review, 4), round(unsafe, 4), 'secondary manual review' FROM c
UNION ALL SELECT 'priority_1_unsafe', 'unsafe', round(unsafe, 4), NULL, 'auto-block or priority analyst verification' FROM c""")
def o04(spark, d):
    return S.zones(E.fit_cuts(scored(spark, d).withColumn("risk_score", S.blend(detectors())[0]))).drop("range")


@query("w09_ecdf_rank", with_(FEATS) + "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cume_dist() OVER (ORDER BY isoforest) AS ecdf FROM feats")
def w09(spark, d):
    return E.ecdf_rank(scored(spark, d).select(*KEYS, "isoforest"), "isoforest").select(*KEYS, "ecdf")


CURVE = """byscore AS (SELECT isoforest AS s, sum(label) AS p, sum(1 - label) AS n FROM feats GROUP BY 1),
cum AS (SELECT s, p, n, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp, sum(p) OVER () AS pp, sum(n) OVER () AS nn FROM byscore)"""


@query("w11_roc_auc", with_(FEATS) + """, r AS (SELECT label, (rank() OVER (ORDER BY isoforest) + rank() OVER (ORDER BY isoforest) + count(*) OVER (PARTITION BY isoforest) - 1) / 2.0::DOUBLE AS rk FROM feats)
SELECT round((sum(CASE WHEN label = 1 THEN rk END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label)::DOUBLE * sum(1 - label)), 9) AS roc_auc FROM r""")
def w11(spark, d):
    return E.roc_auc(scored(spark, d), "label", "isoforest").select(F.round("roc_auc", 9).alias("roc_auc"))


@query("w12_roc_points", with_(FEATS, CURVE) + "SELECT s AS threshold, fp / nn::DOUBLE AS fpr, tp / pp::DOUBLE AS tpr FROM cum")
def w12_roc(spark, d):
    return E.roc_points(scored(spark, d), "label", "isoforest")


@query("w12_pr_points", with_(FEATS, CURVE) + "SELECT s AS threshold, tp / (tp + fp)::DOUBLE AS precision, tp / pp::DOUBLE AS recall FROM cum")
def w12_pr(spark, d):
    return E.pr_points(scored(spark, d), "label", "isoforest")


@query("w12_average_precision", with_(FEATS, CURVE) + "SELECT round(sum(tp / (tp + fp)::DOUBLE * p / pp), 9) AS average_precision FROM cum")
def w12_ap(spark, d):
    return E.average_precision(scored(spark, d), "label", "isoforest").select(F.round("average_precision", 9).alias("average_precision"))


@query("m01_customer_split", "SELECT CAST(c_custkey AS VARCHAR) AS customer_key, row_number() OVER (ORDER BY md5(concat('42|', c_custkey)), c_custkey) <= greatest(floor(count(*) OVER () * 0.2), 1) AS holdout FROM customer")
def m01(spark, d):
    return E.split_customers(load(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("customer_key")))


@query("m11_proxy_metrics", with_(FEATS, RISK) + """, g AS (SELECT DISTINCT unnest(quantile_cont(risk_score, [""" + ", ".join(f"{0.80 + i * (0.999 - 0.80) / 39:.15f}" for i in range(40)) + """])) AS t FROM risk),
m AS (SELECT t, sum(CASE WHEN risk_score >= t THEN label END) AS tp, sum(CASE WHEN risk_score >= t THEN 1 - label END) AS fp, sum(label) AS p, sum(1 - label) AS n FROM risk, g GROUP BY t)
SELECT round(t, 4) AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, (p - tp)::BIGINT AS fn, (n - fp)::BIGINT AS tn, round(tp / (tp + fp)::DOUBLE, 9) AS precision, round(tp / p::DOUBLE, 9) AS recall,
  round((tp + n - fp) / (p + n)::DOUBLE, 9) AS accuracy, round(2 * tp / (2 * tp + fp + p - tp)::DOUBLE, 9) AS f1 FROM m ORDER BY 2 * tp / (2 * tp + fp + p - tp)::DOUBLE DESC, t LIMIT 1""")
def m11(spark, d):
    out = E.evaluate_proxy(scored(spark, d).withColumn("risk_score", S.blend(detectors())[0]), "label")
    return out.select(F.round("threshold", 4).alias("threshold"), "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "accuracy", "f1")])


@query("m10_unsupervised_evaluation", with_(FEATS, RISK) + """, r AS (SELECT label, risk_score, (rank() OVER (ORDER BY risk_score) + rank() OVER (ORDER BY risk_score) + count(*) OVER (PARTITION BY risk_score) - 1) / 2.0::DOUBLE AS rk FROM risk)
SELECT round((sum(CASE WHEN label = 1 THEN rk END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label)::DOUBLE * sum(1 - label)), 8) AS synthetic_auc, count(*) FILTER (WHERE label = 0) AS n_holdout_normal,
  count(*) FILTER (WHERE label = 1) AS n_synthetic, round(quantile_cont(risk_score, 0.5) FILTER (WHERE label = 0), 8) AS normal_risk_median, round(quantile_cont(risk_score, 0.99) FILTER (WHERE label = 0), 8) AS normal_risk_p99,
  round(quantile_cont(risk_score, 0.5) FILTER (WHERE label = 1), 8) AS synthetic_risk_median, round(quantile_cont(risk_score, 0.5) FILTER (WHERE label = 1) - quantile_cont(risk_score, 0.99) FILTER (WHERE label = 0), 7) AS contamination_gap FROM r""")
def m10(spark, d):
    df = scored(spark, d).withColumn("risk_score", S.blend(detectors())[0])
    out = E.evaluate_unsupervised(df.where("label = 0"), df.where("label = 1"))
    return out.select("n_holdout_normal", "n_synthetic", *[F.round(c, 8).alias(c) for c in ("synthetic_auc", "normal_risk_median", "normal_risk_p99", "synthetic_risk_median")],
                      F.round("contamination_gap", 7).alias("contamination_gap"))


SYN_AXES = [c for c in E.SPIKES]


def syn_u(*parts: str) -> str:
    return "(CAST(concat('0x', substr(md5(concat_ws('|', '42', " + ", ".join(parts) + ")), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE)"


RID = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


@query("m09_synthetic_anomalies", with_(FEATS) + f""", u AS (SELECT *, {RID} AS rid FROM feats), v AS (SELECT *, CAST(floor({syn_u("'k'", 'rid')} * 4) AS INT) + 2 AS k, 0.35::DOUBLE + 0.85::DOUBLE * {syn_u("'strength'", 'rid')} AS st,
  [{', '.join(syn_u(f"'{c}'", 'rid') for c in SYN_AXES)}] AS us FROM u), z AS (SELECT *, list_sort(us)[k] AS lim FROM v)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN us[2] <= lim THEN 1 + 24 * st * (0.7::DOUBLE + 0.6::DOUBLE * {syn_u("'v'", "'amt_over_median'", 'rid')}) ELSE amt_over_median END, 6) AS amt_over_median,
  CASE WHEN us[9] <= lim THEN CASE WHEN {syn_u("'v'", "'location_new'", 'rid')} < 0.5::DOUBLE + 0.4::DOUBLE * st THEN 1.0 ELSE 0.0 END ELSE location_new END AS location_new,
  round(CASE WHEN us[15] <= lim THEN 1 + 7 * st * (0.7::DOUBLE + 0.6::DOUBLE * {syn_u("'v'", "'vel_1h'", 'rid')}) ELSE vel_1h END, 6) AS vel_1h, k AS spiked FROM z""")
def m09(spark, d):
    base = scored(spark, d)
    rid = F.concat_ws("|", *KEYS)
    out = E.synthesize(base, rid)
    k = F.floor(E.uniform(F.lit(42), F.lit("k"), rid) * 4).cast("int") + 2
    return out.select(*KEYS, F.round("amt_over_median", 6).alias("amt_over_median"), "location_new", F.round("vel_1h", 6).alias("vel_1h"), k.alias("spiked"))


@query("o17_score_histogram", with_(FEATS, RISK) + "SELECT label, CAST(least(floor(risk_score * 60), 59) AS INT) AS bin, count(*) AS n, CAST(least(floor(risk_score * 60), 59) AS INT) / 60.0::DOUBLE AS lower FROM risk GROUP BY ALL")
def o17(spark, d):
    return E.score_histogram(scored(spark, d).withColumn("risk_score", S.blend(detectors())[0]), "risk_score", "label")
