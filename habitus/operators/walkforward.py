"""Models trained month by month and judged on the month after, all in one job, as rows of a registry.

A model is what one month of clean transactions says about amounts: centre and spread of their logarithm, and the cut that five in
a hundred of them exceed. It scores a transaction by its distance from the centre. The month after judges it twice: how well
distances separate clean rows from synthetic anomalies, and how well the cut finds the rows labelled bad.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from habitus.operators.evaluate import roc_auc_by
from habitus.operators.ordered import quantiles
from habitus.session import materialize

CUT = 0.95


def distance(x: Column) -> Column:
    return F.abs(x - F.col("centre")) / F.col("spread")


def train_months(rows: DataFrame, label: str = "bad") -> DataFrame:
    """seq, month, centre, spread, cut per month with clean rows. Months are few and large, so their rows are split by value."""
    logs = rows.where(~F.col(label)).select(F.date_trunc("month", "ts").alias("month"), F.log("amount").alias("x"))
    q = quantiles(logs, "x", {"low": 0.25, "centre": 0.5, "high": 0.75}, ("month",), few=True)
    fits = materialize(q.select("month", "centre", F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0).alias("spread")), "fits")
    cuts = quantiles(logs.join(fits, "month").withColumn("d", distance(F.col("x"))), "d", {"cut": CUT}, ("month",), few=True)
    return fits.join(cuts, "month").withColumn("seq", F.row_number().over(Window.orderBy("month")))  # a row per month


def judge_months(rows: DataFrame, models: DataFrame, synthetic: Column, label: str = "bad") -> DataFrame:
    """One row per model that has a month after it: version, seq, synthetic_auc, n_rows, precision, recall, f1.

    `synthetic` is the factor by which a clean row's amount becomes its anomaly. Precision without a flagged row, and recall without a bad
    one, are null.
    """
    judged_by = models.select((F.col("seq") + 1).alias("seq"), "centre", "spread", "cut", F.date_format("month", "yyyy-MM").alias("version"))
    months = models.select("seq", "month").join(judged_by, "seq")
    later = rows.select(F.date_trunc("month", "ts").alias("month"), F.log("amount").alias("x"), F.col(label).alias("_bad"), synthetic.alias("_factor"))
    scored = materialize(later.join(months, "month").select("version", "seq", "_bad", distance(F.col("x")).alias("d"), distance(F.col("x") + F.log("_factor")).alias("s"), "cut"), "judged")
    pairs = scored.where("NOT _bad").select("version", F.explode(F.array(F.struct(F.col("d").alias("risk"), F.lit(0).alias("y")), F.struct(F.col("s").alias("risk"), F.lit(1).alias("y")))).alias("p"))
    auc = roc_auc_by(pairs.select("version", "p.risk", "p.y"), ("version",), "y", "risk").withColumnRenamed("roc_auc", "synthetic_auc")
    flagged = F.col("d") >= F.col("cut")
    found = scored.groupBy("version").agg(
        (F.max("seq") - 1).alias("seq"), F.count("*").alias("n_rows"), F.count_if(flagged & F.col("_bad")).alias("tp"), F.count_if(flagged).alias("flagged"), F.count_if("_bad").alias("bad"))
    precision, recall = F.try_divide("tp", F.col("flagged")), F.try_divide("tp", F.col("bad"))
    f1 = F.try_divide(2 * F.col("tp"), F.col("flagged") + F.col("bad"))
    return found.join(auc, "version", "left").select("version", "seq", "synthetic_auc", "n_rows", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))
