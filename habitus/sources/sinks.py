"""Profile publication, history, lineage and the event trail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def stale(prev: DataFrame, seen: DataFrame, keys: tuple[str, ...] = ("entity_key",)) -> DataFrame:
    """Stored profiles that this run did not see."""
    return prev.join(seen, list(keys), "left_anti")


def publish_profiles(prev: DataFrame, new: DataFrame, touched: DataFrame, run_id: str, prune: bool = True, keys: tuple[str, ...] = ("entity_key",)) -> DataFrame:
    """The next state of the profile table: rewritten profiles, unchanged ones marked as seen, and, unless pruned, the rest."""
    k = list(keys)
    rewritten = new.withColumn("run_id", F.lit(run_id))
    others = prev.join(new.select(*k), k, "left_anti")
    kept = others.join(touched.select(*k).distinct(), k, "left_semi").withColumn("run_id", F.lit(run_id))
    out = rewritten.unionByName(kept, allowMissingColumns=True)
    return out if prune else out.unionByName(others.join(touched.select(*k), k, "left_anti"), allowMissingColumns=True)


def append_history(profiles: DataFrame, run_id: str, path: str, full: bool = False, schema_version: int = 1) -> None:
    """Append a snapshot of a run; `full` stores the whole profile as JSON beside the scalars, under its schema version. Re-running
    a run replaces it."""
    scalars = ("entity_key", "currency", "profile_version", "total_tx_count", "total_tx_amount", "avg_amount", "decayed_avg_amount")
    snapshot = profiles.select(
        *[c for c in scalars if c in profiles.columns], (F.to_json(F.struct("*")) if full else F.lit(None).cast("string")).alias("profile_json"), F.lit(schema_version).alias("schema_version"))
    snapshot.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def run_lineage(source: DataFrame, profiles: DataFrame, run_id: str) -> DataFrame:
    """One row about a build: its window, how many rows it read and how many entities it wrote."""
    one = F.lit(1).alias("_one")
    window = source.agg(F.min("ts").alias("window_start"), F.max("ts").alias("window_end"), F.count("*").alias("source_rows")).select("*", one)
    written = profiles.agg(F.count("*").alias("entities")).select("*", one)
    return window.join(written, "_one").select(F.lit(run_id).alias("run_id"), "window_start", "window_end", "source_rows", "entities", F.lit("done").alias("status"))


def append_events(df: DataFrame, event_type: str, path: str, run: str) -> None:
    """Add one run's events to the trail, one folder per day and run; a repeated run replaces its own. `detail` becomes JSON."""
    df.select("entity_key", "transaction_id", F.lit(event_type).alias("event_type"), "outcome", F.to_json("detail").alias("detail"), "ts", F.to_date("ts").alias("day"), F.lit(run).alias("run")
              ).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "run").parquet(path)
