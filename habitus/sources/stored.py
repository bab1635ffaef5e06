"""Tables that runs rewrite in place: transactions by day, and profiles of which each run publishes a whole snapshot.

Spark stages what it writes and moves it when the job commits, so a run that fails leaves what was there. A snapshot of
profiles is read only once its run is recorded as done, which is one small write.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from habitus.operators.filters import latest
from habitus.session import materialize
from habitus.sources.ingest import upsert
from habitus.sources.sinks import publish_profiles


def folder(spark: SparkSession, path: str):
    """(file system, path) of a folder, wherever Spark keeps it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def partitions(spark: SparkSession, path: str, name: str) -> dict[str, object]:
    """Value and folder of each partition `name=value` right below a path; none if there is no such path."""
    fs, at = folder(spark, path)
    found = fs.listStatus(at) if fs.exists(at) else []
    return {s.getPath().getName().partition("=")[2]: s.getPath() for s in found if s.getPath().getName().startswith(f"{name}=")}


# --- transactions by day ---------------------------------------------------------------------------------------------------------

def day_of(ts: Column | str, unit: str = "day") -> Column:
    """The partition of a moment: its day, or the first day of its month where rows are few."""
    return F.to_date(F.date_trunc(unit, ts))


def write_days(df: DataFrame, path: str, ts: str = "ts", unit: str = "day") -> None:
    """Replace the days that df has rows of; other days stay. A day's rows meet in one file, or more where the day is large."""
    df.withColumn("day", day_of(ts, unit)).hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def since(df: DataFrame, start: Column, ts: str = "ts", unit: str = "day") -> DataFrame:
    """Rows from a moment on; earlier days are not read at all."""
    return df.where((F.col("day") >= day_of(start, unit)) & (F.col(ts) >= start))


def merge_days(spark: SparkSession, path: str, delta: DataFrame, keys: list[str], order: tuple[str, ...], ts: str = "ts", unit: str = "day", keep_newest: bool = False) -> None:
    """Upsert into a table by day: only days that the delta touches are read and written again.

    A row keeps its day. The delta's rows replace stored ones, or, with keep_newest, the last of both in `order` stays. The number of days is that of a calendar, so they may be listed on the driver. The next state of these days is
    stored before it replaces them, because a job cannot read what it overwrites.
    """
    dated = delta.withColumn("day", day_of(ts, unit))
    days = [r["day"] for r in dated.select("day").distinct().collect()]
    if not days:
        return
    touched = None
    if partitions(spark, path, "day"):
        known = F.col("day").isin([d for d in days if d is not None])
        touched = spark.read.parquet(path).where(known | F.col("day").isNull() if None in days else known)
    base = touched.select(*dated.columns) if touched is not None else dated.where("false")
    merged = latest(base.unionByName(dated), ["day", *keys], order) if keep_newest else upsert(base, dated, ["day", *keys], order)
    write_days(materialize(merged, "days").drop("day"), path, ts, unit)


def prune_days(spark: SparkSession, path: str, start: str, ts: str = "ts", unit: str = "day") -> int:
    """Drop rows before a moment (text like 2000-01-31 12:00:00): earlier days as folders, and the moment's own day rewritten.
    Returns the number of folders dropped."""
    fs, _ = folder(spark, path)
    day = start[:10] if unit == "day" else f"{start[:7]}-01"
    early = [p for value, p in partitions(spark, path, "day").items() if len(value) == 10 and value < day]
    for p in early:
        fs.delete(p, True)
    if day in partitions(spark, path, "day") and (start[:10] != day or start[10:].strip(" 0:T")):
        kept = materialize(spark.read.parquet(path).where((F.col("day") == F.lit(day).cast("date")) & (F.col(ts) >= F.lit(start).cast("timestamp"))), "days")
        if kept.isEmpty():
            fs.delete(partitions(spark, path, "day")[day], True)
        else:
            write_days(kept.drop("day"), path, ts, unit)
    return len(early)


# --- profiles by run -------------------------------------------------------------------------------------------------------------

RUN = "seq long, source_rows long, entities long, pruned boolean, detail string"


def mark_run(spark: SparkSession, path: str, run: str, phase: str, seq: int, source_rows: int | None = None, entities: int | None = None, pruned: bool | None = None, detail: str | None = None) -> None:
    row = spark.createDataFrame([(seq, source_rows, entities, pruned, detail)], RUN)
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/runs/run={run}/phase={phase}")


def runs(spark: SparkSession, path: str) -> DataFrame:
    """run, seq, phase (running, failed or done: the furthest that is recorded), source_rows, entities, pruned, detail."""
    schema = f"{RUN}, run string, phase string"
    if not partitions(spark, f"{path}/runs", "run"):
        return spark.createDataFrame([], schema)
    marks = spark.read.schema(schema).parquet(f"{path}/runs")
    far = F.when(F.col("phase") == "done", 2).when(F.col("phase") == "failed", 1).otherwise(0)
    return marks.groupBy("run").agg(F.max_by(F.struct("seq", "phase", "source_rows", "entities", "pruned", "detail"), far).alias("m")).select("run", "m.*")


def current_profiles(spark: SparkSession, path: str) -> DataFrame | None:
    """The snapshot of the newest run that is done; None before the first."""
    done = runs(spark, path).where("phase = 'done'").orderBy(F.desc("seq"), F.desc("run")).select("run").first()
    return spark.read.parquet(f"{path}/profiles/snapshot={done['run']}") if done else None


def store_profiles(spark: SparkSession, path: str, run: str, new: DataFrame, touched: DataFrame, prune: bool = True, keys: tuple[str, ...] = ("entity_key",), source_rows: int | None = None) -> None:
    """Publish a run: rewritten profiles, touched ones marked as seen, and, unless pruned, the rest, in one new snapshot.

    Until the run is recorded as done readers see the snapshot before it. A run that fails is recorded as failed; one that is
    repeated replaces its own snapshot. Snapshots of earlier runs are dropped last.
    """
    seq = (runs(spark, path).agg(F.max("seq")).first()[0] or 0) + 1
    mark_run(spark, path, run, "running", seq, source_rows)
    try:
        prev = current_profiles(spark, path)
        state = publish_profiles(prev, new, touched, run, prune, keys) if prev is not None else new.withColumn("run_id", F.lit(run))
        target = f"{path}/profiles/snapshot={run}"
        state = materialize(state, "profiles")  # a repeated run reads the snapshot that it replaces
        state.write.mode("overwrite").parquet(target)
        entities = state.count()
    except Exception as e:
        mark_run(spark, path, run, "failed", seq, source_rows, detail=str(e)[:1000])
        raise
    mark_run(spark, path, run, "done", seq, source_rows, entities, prune)
    fs, _ = folder(spark, path)
    for name, p in partitions(spark, f"{path}/profiles", "snapshot").items():
        if name != run:
            fs.delete(p, True)


# --- syncs in two phases ---------------------------------------------------------------------------------------------------------

ATTEMPT = "last_id long, rows long, newest timestamp, detail string"


def mark_sync(spark: SparkSession, path: str, source: str, attempt: int, phase: str, last_id: int | None = None, rows: int | None = None, newest=None, detail: str | None = None) -> None:
    spark.createDataFrame([(last_id, rows, newest, detail)], ATTEMPT).coalesce(1).write.mode("overwrite").parquet(f"{path}/source={source}/attempt={attempt}/phase={phase}")


def sync_log(spark: SparkSession, path: str) -> DataFrame:
    schema = f"{ATTEMPT}, source string, attempt long, phase string"
    return spark.read.schema(schema).parquet(path) if partitions(spark, path, "source") else spark.createDataFrame([], schema)


def sync_state(log: DataFrame) -> DataFrame:
    """Per source: last_id (of committed attempts alone), rows_total, newest, last_attempt, last_status, last_detail, crashed.

    A last attempt that only started is `running`; an earlier one that never ended counts as crashed. A failed attempt has no part
    in the watermark. An attempt that committed no rows is idle.
    """
    ended = F.col("phase").isin("committed", "failed")
    per = log.groupBy("source", "attempt").agg(
        F.max(F.when(F.col("phase") == "committed", F.col("last_id"))).alias("last_id"), F.max(F.when(F.col("phase") == "committed", F.col("rows"))).alias("rows"),
        F.max(F.when(F.col("phase") == "committed", F.col("newest"))).alias("newest"), F.max(F.when(F.col("phase") == "failed", F.col("detail"))).alias("detail"),
        F.bool_or(F.col("phase") == "committed").alias("committed"), F.bool_or(ended).alias("ended"))
    status = F.when(F.col("committed") & (F.coalesce("rows", F.lit(0)) > 0), "ok").when(F.col("committed"), "idle").when(F.col("ended"), "failed").otherwise("running")
    last = F.struct(status.alias("status"), F.col("detail").alias("detail"), F.col("ended").alias("ended"))
    out = per.groupBy("source").agg(
        F.coalesce(F.max("last_id"), F.lit(0)).cast("long").alias("last_id"), F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("rows_total"), F.max("newest").alias("newest"),
        F.max("attempt").alias("last_attempt"), F.max_by(last, "attempt").alias("_last"), F.count_if(~F.col("ended")).alias("_open"))
    return out.select("source", "last_id", "rows_total", "newest", "last_attempt", F.col("_last.status").alias("last_status"), F.col("_last.detail").alias("last_detail"),
                      (F.col("_open") - F.when(F.col("_last.ended"), 0).otherwise(1)).cast("long").alias("crashed"))


def sync(spark: SparkSession, path: str, source: str, pull: Callable[[int], DataFrame], store: Callable[[DataFrame], None]) -> int:
    """One incremental sync: pull rows beyond the watermark, store them, then commit the new watermark. Returns the number of rows.

    The rows are fixed before they are stored, so what is committed is what was stored. A crash between leaves an attempt
    without an end, and the same rows are pulled again; storing is an upsert, so nothing is doubled.
    """
    state = sync_state(sync_log(spark, path).where(F.col("source") == source)).first()
    attempt, last_id = (state["last_attempt"] + 1, state["last_id"]) if state else (1, 0)
    mark_sync(spark, path, source, attempt, "started", last_id)
    try:
        rows = materialize(pull(last_id), "pulled")
        store(rows)
        seen = rows.agg(F.max("id").alias("id"), F.count("*").alias("n"), F.max("ts").alias("ts")).first()
    except Exception as e:
        mark_sync(spark, path, source, attempt, "failed", detail=str(e)[:1000])
        raise
    mark_sync(spark, path, source, attempt, "committed", max(seen["id"] or 0, last_id), seen["n"], seen["ts"])
    return seen["n"]
