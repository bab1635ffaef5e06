"""The scoring log: JSON lines in one folder per day, with a nested geography record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from habitus.schemas import INFERENCE_LOG


def log_rows(events: DataFrame) -> DataFrame:
    """Events as log records: category is the outcome, amount the score, and some have a speed."""
    missing = F.col("category") == "error"
    clicked = F.col("category") == "click"
    return events.select(
        F.lit("inference").alias("event"), "ts", F.col("event_id").cast("string").alias("transaction_id"), "customer_key",
        F.col("category").alias("status"), F.col("amount").alias("risk_score"), (F.col("category") == "signup").alias("is_cold_start"),
        F.struct(
            F.when(missing, "unavailable").otherwise("coordinates").alias("geo_source"), (F.col("category") != "signup").alias("geo_eligible"),
            F.when(~missing, F.col("amount") * 2).alias("geo_precision_m"), F.when(missing, "no_evidence").alias("unresolved_reason"),
            clicked.cast("int").alias("geo_velocity_available"), F.when(clicked, F.col("amount") * 10).alias("geo_velocity_kmh"),
        ).alias("geo"),
        F.to_date("ts").alias("day"))


def write_inference_log(df: DataFrame, path: str, run: str) -> None:
    """Add the log records of one run, one folder per day and run; a repeated run replaces its own records."""
    df.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "run").json(path)


def read_inference_log(spark: SparkSession, path: str) -> DataFrame:
    """Read log records under the fixed schema; malformed lines are dropped, and a filter on `day` prunes folders."""
    return spark.read.schema(INFERENCE_LOG).option("mode", "DROPMALFORMED").json(path)
