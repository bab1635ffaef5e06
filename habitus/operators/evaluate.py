"""Model evaluation: ranks, curves, thresholds, calibration, hold-out split and synthetic anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from habitus.config import DEFAULTS, SPIKES
from habitus.operators.ordered import dense_index, quantile_arrays, quantiles, running_sums


def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score: what every curve needs, counted before any ordering."""
    y = F.col(label).cast("int")
    return df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


def ranked_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """Distinct scores with the positives and negatives below them, and the totals."""
    return running_sums(score_counts(df, label, score), "score", ["pos", "neg"])


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Probability that a positive outranks a negative; ties count half. Null when a class is missing."""
    r = ranked_counts(df, label, score)
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2.0))
    return r.agg(F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def roc_auc_by(df: DataFrame, keys: tuple[str, ...], label: str, score: str) -> DataFrame:
    """roc_auc of each of a few large groups."""
    y = F.col(label).cast("int")
    counts = df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).cast("double").alias("score")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    r = running_sums(counts, "score", ["pos", "neg"], keys, few=True)
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2.0))
    return r.groupBy(*keys).agg(F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """One point per distinct threshold: rates of rows at or above it."""
    r = ranked_counts(df, label, score)
    return r.select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("neg_total") - F.col("neg_before"), F.col("neg_total")).alias("fpr"),
        F.try_divide(F.col("pos_total") - F.col("pos_before"), F.col("pos_total")).alias("tpr"))


def pr_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """Precision and recall per distinct threshold."""
    r = ranked_counts(df, label, score)
    tp, fp = F.col("pos_total") - F.col("pos_before"), F.col("neg_total") - F.col("neg_before")
    return r.select(F.col("score").alias("threshold"), (tp / (tp + fp)).alias("precision"), F.try_divide(tp, F.col("pos_total")).alias("recall"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Precision weighted by the recall each threshold adds."""
    r = ranked_counts(df, label, score)
    tp, fp = F.col("pos_total") - F.col("pos_before"), F.col("neg_total") - F.col("neg_before")
    return r.agg(F.sum(tp / (tp + fp) * F.try_divide(F.col("pos"), F.col("pos_total"))).alias("average_precision"))


def ecdf_rank(df: DataFrame, score: str) -> DataFrame:
    """Share of scored rows at or below each row's score: the exact training-set form of the normaliser. No score, no share."""
    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("_s")).agg(F.count("*").alias("n"))
    ranks = running_sums(counts, "_s", ["n"])
    shares = ranks.select("_s", ((F.col("n_before") + F.col("n")) / F.col("n_total")).alias("ecdf"))
    return df.join(shares, df[score] == shares["_s"], "left").drop("_s")


def fit_quantiles(df: DataFrame, score: str, n: int = 1001) -> DataFrame:
    """The stored form of a score distribution: n evenly spaced quantiles."""
    qs = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i / float(n - 1))
    return quantile_arrays(df, score, qs, name="quantiles")


def fit_cuts(df: DataFrame, risk: str = "risk_score", percentiles: dict[str, float] | None = None) -> DataFrame:
    """Tier cuts: percentiles of the hold-out risk."""
    p = percentiles or DEFAULTS.tier_percentiles
    return quantiles(df, risk, {k: v / 100.0 for k, v in p.items()})


def split_customers(keys: DataFrame, frac: float = DEFAULTS.holdout_frac, seed: int = DEFAULTS.seed, key: str = "customer_key") -> DataFrame:
    """Mark exactly max(1, floor(n * frac)) customers as hold-out: the first ones in the order of a seeded digest."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), key))
    numbered = dense_index(keys.select(key).distinct(), key, order, "_i")
    size = numbered.agg(F.greatest(F.floor(F.count("*") * frac), F.lit(1))).scalar()
    return numbered.withColumn("holdout", F.col("_i") < size).drop("_i")


def holdout_rule(keys: DataFrame, frac: float = DEFAULTS.holdout_frac, seed: int = DEFAULTS.seed, key: str = "customer_key") -> Column:
    """split_customers as a condition on a row's key, which needs no join: the last hold-out customer is looked up once."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), key))
    numbered = dense_index(keys.select(key).distinct(), key, order, "_i")
    size = numbered.agg(F.greatest(F.floor(F.count("*") * frac), F.lit(1))).scalar()
    last = numbered.where(F.col("_i") == size - 1).select(order.alias("o"), F.col(key).alias("k")).first()
    return F.lit(False) if last is None else (order < last["o"]) | ((order == last["o"]) & (F.col(key) <= last["k"]))


def uniform(*parts: Column) -> Column:
    """Repeatable uniform number in [0, 1) from the parts."""
    digits = F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12), 16, 10)
    return digits.cast("double") / float(16**12)


def synthesize(normal: DataFrame, row_id: Column, seed: int = DEFAULTS.seed) -> DataFrame:
    """One synthetic anomaly per normal row: 2 to 5 deviation axes are spiked, by an amount that varies per row.

    Which axes: those whose seeded draw is among the row's smallest. Binary axes fire with a chance that grows with
    the row's strength; magnitude axes scale with it. The amount follows the spiked ratio to the median.
    """
    s = F.lit(seed)
    axes = [c for c in SPIKES if c in normal.columns]
    rows = normal.withColumns({
        "_rid": row_id.cast("string")}).withColumns({
        "_k": F.floor(uniform(s, F.lit("k"), F.col("_rid")) * 4).cast("int") + 2,
        "_strength": 0.35 + 0.85 * uniform(s, F.lit("strength"), F.col("_rid"))})
    rows = rows.withColumns({f"_u_{c}": uniform(s, F.lit(c), F.col("_rid")) for c in axes})
    rows = rows.withColumn("_limit", F.get(F.sort_array(F.array(*[f"_u_{c}" for c in axes])), F.col("_k") - 1))

    def spiked(axis: str) -> Column:
        draw = uniform(s, F.lit("v"), F.lit(axis), F.col("_rid"))
        size = SPIKES[axis]
        if size <= 1.0:
            new = F.when(draw < 0.5 + 0.4 * F.col("_strength"), 1.0).otherwise(0.0)
        else:
            new = 1.0 + (size - 1.0) * F.col("_strength") * (0.7 + 0.6 * draw)
        return F.when(F.col(f"_u_{axis}") <= F.col("_limit"), new).otherwise(F.col(axis))

    out = rows.withColumns({c: spiked(c) for c in axes})
    if "amt_log" in normal.columns:
        out = out.withColumn("amt_log", F.col("amt_log") + F.log1p(F.greatest(F.col("amt_over_median") - 1.0, F.lit(0.0))))
    return out.select(*normal.columns)


def evaluate_unsupervised(normal: DataFrame, synthetic: DataFrame, risk: str = "risk_score", band: tuple = DEFAULTS.synthetic_band) -> DataFrame:
    """Label-free quality: how well risk separates hold-out rows from synthetic anomalies."""
    both = normal.select(risk, F.lit(0).alias("y")).unionByName(synthetic.select(risk, F.lit(1).alias("y")))
    auc = roc_auc(both, "y", risk)
    n = quantiles(normal, risk, {"normal_risk_median": 0.5, "normal_risk_p99": 0.99})
    a = quantiles(synthetic, risk, {"synthetic_risk_median": 0.5})
    sizes = both.groupBy().agg(F.count_if(F.col("y") == 0).alias("n_holdout_normal"), F.count_if(F.col("y") == 1).alias("n_synthetic"))
    one = F.lit(1).alias("_one")
    out = auc.select(F.col("roc_auc").alias("synthetic_auc"), one)
    for part in (n, a, sizes):
        out = out.join(part.select("*", one), "_one")
    return out.drop("_one").withColumns({
        "contamination_gap": F.col("synthetic_risk_median") - F.col("normal_risk_p99"),
        "auc_in_band": F.col("synthetic_auc").between(*band), "auc_at_or_above_band": F.col("synthetic_auc") >= band[0]})


def evaluate_proxy(df: DataFrame, label: str, risk: str = "risk_score") -> DataFrame:
    """Weak-label metrics at the threshold, out of 40 high quantiles, with the best F1; the lower one wins ties.

    Confusion counts of all candidate thresholds come from one pass over distinct scores.
    """
    grid = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: 0.80 + i * ((0.999 - 0.80) / 39.0))
    counts = score_counts(df, label, risk)
    grid_values = quantile_arrays(df, risk, grid, name="grid").select(F.array_sort(F.array_distinct("grid")).alias("grid"))
    # each distinct score adds to the number of thresholds it reaches: bucket by that number, then accumulate 40 buckets
    reach = counts.withColumn("_g", grid_values.scalar()).withColumn("reached", F.size(F.filter("_g", lambda t: t <= F.col("score"))))
    buckets = reach.groupBy("reached").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    packed = buckets.agg(F.collect_list(F.struct("reached", "pos", "neg")).alias("b"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))

    def above(i: Column, f: str) -> Column:
        return F.aggregate(F.filter("b", lambda e: e["reached"] > i), F.lit(0).cast("long"), lambda acc, e: acc + e[f])

    packed = packed.withColumn("g", grid_values.scalar())
    rows = packed.select("p", "n", "b", F.posexplode("g").alias("i", "threshold")).withColumns({
        "tp": above(F.col("i"), "pos"), "fp": above(F.col("i"), "neg")})
    rows = rows.withColumns({"fn": F.col("p") - F.col("tp"), "tn": F.col("n") - F.col("fp")})
    zero = F.lit(0.0)
    rows = rows.withColumns({
        "precision": F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), zero),
        "recall": F.coalesce(F.try_divide(F.col("tp"), F.col("p")), zero),
        "accuracy": (F.col("tp") + F.col("tn")) / (F.col("p") + F.col("n")),
        "f1": F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), zero)})
    cols = ("threshold", "tp", "fp", "fn", "tn", "precision", "recall", "accuracy", "f1")
    return rows.agg(F.max_by(F.struct(*cols), F.struct(F.col("f1"), -F.col("i"))).alias("best")).select("best.*")


def score_histogram(df: DataFrame, score: str, label: str, bins: int = 60) -> DataFrame:
    """Counts per label over equal-width bins of [0, 1]; 1 belongs to the last bin."""
    bucket = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(F.col(label).alias("label"), bucket.alias("bin")).agg(F.count("*").alias("n")).withColumn("lower", F.col("bin") / float(bins))
