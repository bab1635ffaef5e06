"""Stored tables: pruned scans, merges by day, failed runs and syncs that leave what was there, whole restores, remote reads."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from habitus.operators import govern as V
from habitus.session import scratch
from habitus.sources import ingest as I, remote as R, sinks as K, stored as T

ROWS = [(i, i % 3, float(i), dt.datetime(2024, 1, 1 + i % 10, i % 24)) for i in range(200)]
SCHEMA = "id long, version long, amount double, ts timestamp"


def files(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_days_are_pruned_in_the_scan(spark):
    path = scratch(spark, "days")
    T.write_days(spark.createDataFrame(ROWS, SCHEMA), path)
    df = T.since(spark.read.parquet(path), F.lit("2024-01-08 06:00:00").cast("timestamp"))
    plan = files(df)
    assert "PartitionFilters: [isnotnull(day" in plan and "day#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert sorted(r.id for r in df.collect()) == [r[0] for r in ROWS if r[3] >= dt.datetime(2024, 1, 8, 6)]


def test_merge_touches_only_the_days_of_the_delta(spark):
    path = scratch(spark, "days")
    T.write_days(spark.createDataFrame(ROWS, SCHEMA), path)
    fs, at = T.folder(spark, f"{path}/day=2024-01-05")
    before = fs.getFileStatus(at).getModificationTime(), sorted(s.getPath().getName() for s in fs.listStatus(at))
    delta = [(3, 9, -1.0, ROWS[3][3]), (3, 8, -2.0, ROWS[3][3]), (1000, 0, 5.0, dt.datetime(2024, 2, 1)), (1001, 0, 6.0, None)]
    T.merge_days(spark, path, spark.createDataFrame(delta, SCHEMA), ["id"], ("version",))
    got = {r.id: (r.version, r.amount) for r in spark.read.parquet(path).collect()}
    assert got == {r[0]: (r[1], r[2]) for r in ROWS} | {3: (9, -1.0), 1000: (0, 5.0), 1001: (0, 6.0)}
    assert (fs.getFileStatus(at).getModificationTime(), sorted(s.getPath().getName() for s in fs.listStatus(at))) == before
    T.merge_days(spark, path, spark.createDataFrame([], SCHEMA), ["id"], ("version",))
    assert spark.read.parquet(path).count() == 202


def test_prune_drops_folders_and_cuts_the_day_itself(spark):
    path = scratch(spark, "days")
    T.write_days(spark.createDataFrame(ROWS, SCHEMA), path)
    assert T.prune_days(spark, path, "2024-01-04 12:00:00") == 3
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [r[0] for r in ROWS if r[3] >= dt.datetime(2024, 1, 4, 12)]
    assert T.prune_days(spark, path, "2024-01-04 12:00:00") == 0 and T.prune_days(spark, path, "2024-01-05") == 1


def test_a_failed_run_leaves_the_old_profiles(spark):
    path = scratch(spark, "store")
    make = lambda rows: spark.createDataFrame(rows, "entity_key string, total long")
    assert T.current_profiles(spark, path) is None
    T.store_profiles(spark, path, "r1", make([("a", 1), ("b", 2), ("c", 3)]), make([]))
    broken = make([("a", 9)]).withColumn("total", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        T.store_profiles(spark, path, "r2", broken, make([]))
    assert {(r.entity_key, r.total, r.run_id) for r in T.current_profiles(spark, path).collect()} == {("a", 1, "r1"), ("b", 2, "r1"), ("c", 3, "r1")}
    T.mark_run(spark, path, "r3", "running", 3)  # a crash: never ended
    T.store_profiles(spark, path, "r4", make([("a", 10)]), make([("b", 0)]), prune=True)
    for _ in range(2):  # a repeated run replaces its own
        T.store_profiles(spark, path, "r5", make([("d", 4)]), make([("a", 0)]), prune=False)
        assert {(r.entity_key, r.total, r.run_id) for r in T.current_profiles(spark, path).collect()} == {("a", 10, "r5"), ("b", 2, "r4"), ("d", 4, "r5")}
    assert {r.run: (r.phase, r.entities) for r in T.runs(spark, path).collect()} == {"r1": ("done", 3), "r2": ("failed", None), "r3": ("running", None), "r4": ("done", 2), "r5": ("done", 3)}
    assert list(T.partitions(spark, f"{path}/profiles", "snapshot")) == ["r5"]


def test_a_failed_sync_keeps_the_watermark(spark):
    path, table = scratch(spark, "sync"), scratch(spark, "cache")
    source = spark.createDataFrame(ROWS, SCHEMA)
    pull = lambda last: source.where(F.col("id") > last).orderBy("id").limit(50)
    store = lambda rows: T.merge_days(spark, table, rows, ["id"], ("version",))

    def lose(rows):
        raise ValueError("no connection")

    state = lambda: T.sync_state(T.sync_log(spark, path)).first()
    assert state() is None and T.sync(spark, path, "sales", pull, store) == 50
    with pytest.raises(ValueError):
        T.sync(spark, path, "sales", pull, lose)
    s = state()
    assert (s.last_id, s.rows_total, s.last_status, s.last_detail, s.crashed) == (50, 50, "failed", "no connection", 0)
    T.mark_sync(spark, path, "sales", 3, "started")
    assert (state().last_status, state().crashed) == ("running", 0)
    while T.sync(spark, path, "sales", pull, store):
        pass
    s = state()
    assert (s.last_id, s.rows_total, s.last_status, s.crashed) == (199, 199, "idle", 1)
    assert sorted(r.id for r in spark.read.parquet(table).collect()) == list(range(1, 200))


def test_restore_of_whole_profiles(spark):
    path = scratch(spark, "history")
    old = spark.createDataFrame([("a", 1, 5.0, {"x": 1}, 1), ("b", 2, 6.0, {"y": 2}, 1)], "entity_key string, total_tx_count long, avg_amount double, seen map<string,int>, profile_version int")
    K.append_history(old, "r1", path, full=True)
    K.append_history(spark.createDataFrame([("c", 3, 7.0, 1)], "entity_key string, total_tx_count long, avg_amount double, profile_version int"), "r2", path)
    history = K.read_history(spark, path).withColumns({"snapshot_ts": F.lit(0), "profile_json": F.when(F.col("entity_key") == "b", "{broken").otherwise(F.col("profile_json"))})
    now = spark.createDataFrame([(k, 9, 9.0, {"z": 9}, 0.5, 2, None) for k in "abcd"], "entity_key string, total_tx_count long, avg_amount double, seen map<string,int>, later double, profile_version int, retrain_reason string")
    schemas = {1: "entity_key string, total_tx_count long, avg_amount double, seen map<string,int>", 2: "entity_key string, total_tx_count long"}
    got = {r.entity_key: tuple(r)[1:] for r in V.restore(now, history, F.lit(True), schemas, ("total_tx_count", "avg_amount")).collect()}
    assert got == {"a": (1, 5.0, {"x": 1}, 0.5, 1, None, "full"), "b": (2, 6.0, {"z": 9}, 0.5, 1, "rolled_back", "scalars"),
                   "c": (3, 7.0, {"z": 9}, 0.5, 1, "rolled_back", "scalars"), "d": (9, 9.0, {"z": 9}, 0.5, 2, None, None)}


def test_remote_reads_are_partitioned_and_filtered_there(spark):
    url, driver = "jdbc:derby:memory:remote;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.createDataFrame([(i, 1.0 * i, i % 3, None if i % 10 == 0 else f"acc{i}", dt.datetime(2024, 1, 1 + i % 20)) for i in range(1, 501)],
                                 "ID long, AMOUNT double, BRANCH_ID long, ORIGIN_ACCOUNT_NO string, TS timestamp")
    rows.write.format("jdbc").options(url=url, dbtable="SALES", **driver).mode("overwrite").save()
    new = R.pull_new(spark, url, "SALES", 200, "ID", rows_per_part=100, **driver)
    plan = files(new)
    assert new.rdd.getNumPartitions() == 3 and "PushedFilters: [*IsNotNull(ID), *GreaterThan(ID,200), *LessThanOrEqual(ID,500)]" in plan
    assert sorted(r.ID for r in new.collect()) == list(range(201, 501))
    assert R.pull_new(spark, url, "SALES", 500, "ID", **driver).count() == 0 and R.extent(spark, url, "SALES", 500, "ID", **driver) == (500, 0)
    some = R.extract(spark, url, "SALES", "2024-01-15 00:00:00", "TS", "ID", "ORIGIN_ACCOUNT_NO", branch=None, rows_per_part=250, **driver)
    assert "IsNotNull(ORIGIN_ACCOUNT_NO)" in files(some) and "GreaterThanOrEqual(TS" in files(some) and some.rdd.getNumPartitions() == 2
    assert sorted(r.ID for r in some.collect()) == [i for i in range(1, 501) if i % 10 and 1 + i % 20 >= 15]
    picked = some.select("ID", "AMOUNT")
    assert "ReadSchema: struct<ID:bigint,AMOUNT:double>" in files(picked)
    assert I.upsert(rows.limit(0), new, ["ID"], ("AMOUNT",)).count() == 300
