"""Operators that must stay right and distributed when one key holds most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from habitus.config import VELOCITY_MINUTES
from habitus.operators import features as X, filters as L, ordered as O, velocity as V
from habitus.operators.evaluate import average_precision, ecdf_rank, roc_auc
from habitus.operators.forest import tree_samples
from habitus.plans.modelling import split
from habitus.operators import baseline as B
from tests.conftest import SF_DIR


@pytest.fixture(scope="module")
def hot(spark):
    """4,000 rows of one customer among 1,000 of others, with many equal times and amounts."""
    rng = np.random.default_rng(7)
    n = 5000
    pdf = pd.DataFrame({
        "customer_key": np.where(np.arange(n) < 4000, "hot", [f"c{i % 40}" for i in range(n)]),
        "sec": rng.integers(0, 5 * 86400, n) // 30 * 30, "amount": np.round(rng.exponential(100, n), 2), "id": np.arange(n), "version": 0})
    df = spark.createDataFrame(pdf).withColumn("ts", F.timestamp_seconds("sec"))
    return pdf, df


def test_velocity_against_brute_force(hot):
    pdf, df = hot
    got = V.velocity(df).toPandas().set_index("id")
    for _, group in pdf.sort_values(["sec", "id"]).groupby("customer_key"):
        t, a, ids = group["sec"].to_numpy(), group["amount"].to_numpy(), group["id"].to_numpy()
        pos = np.arange(len(t))
        for name, minutes in VELOCITY_MINUTES.items():
            low = np.searchsorted(t, t - minutes * 60, side="left")
            assert (got.loc[ids, f"n_{name}"].to_numpy() == pos - low).all()
        low = np.searchsorted(t, t - 3600, side="left")
        total = np.concatenate([[0.0], np.cumsum(a)])
        assert np.allclose(got.loc[ids, "spend_1h"].to_numpy(), total[pos + 1] - total[low])
        assert (got.loc[ids[1:], "prev_us"].to_numpy() == t[:-1] * 1_000_000).all() and np.isnan(got.loc[ids[0], "prev_us"])


def test_velocity_never_gathers_a_customer(hot):
    """The row windows are partitioned by customer and hour; only the hourly summary is partitioned by customer."""
    plan = V.velocity(hot[1])._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "row_number()" in line:
            assert "customer_key" in line and "_b#" in line.split("windowspecdefinition(")[1].split(" ASC")[0]


@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_quantiles_against_numpy(hot, method):
    pdf, df = hot
    qs = {"q0": 0.0, "q1": 0.05, "q5": 0.5, "q95": 0.95, "q100": 1.0}
    got = O.quantiles(df, "amount", qs, ("customer_key",), method).toPandas().set_index("customer_key")
    for key, group in pdf.groupby("customer_key"):
        x = np.sort(group["amount"].to_numpy())
        for name, q in qs.items():
            want = np.percentile(x, q * 100) if method == "linear" else x[int(np.floor(q * (len(x) - 1) + 0.5))]
            assert got.loc[key, name] == pytest.approx(want)


def test_quantiles_of_signed_values(spark):
    x = np.random.default_rng(3).normal(0, 5, 3000)
    got = O.quantiles(spark.createDataFrame(pd.DataFrame({"x": x})), "x", {"a": 0.1, "b": 0.5, "c": 0.9}).first()
    assert list(got) == pytest.approx(list(np.percentile(x, [10, 50, 90])))


def test_weighted_quantiles_against_numpy(hot):
    pdf, df = hot
    got = O.weighted_quantiles(df.withColumn("w", F.pow(F.lit(0.5), F.col("sec") / 86400)), "amount", "w", {"m": 0.5, "p": 0.95}, ("customer_key",), ("ts", "id")).toPandas().set_index("customer_key")
    for key, group in pdf.groupby("customer_key"):
        g = group.sort_values(["amount", "sec", "id"])
        w = 0.5 ** (g["sec"].to_numpy() / 86400)
        mid = (np.cumsum(w) - w / 2) / w.sum()
        assert got.loc[key, ["m", "p"]].to_list() == pytest.approx(list(np.interp([0.5, 0.95], mid, g["amount"].to_numpy())))


def test_first_row_per_key_is_cut_before_the_shuffle(hot):
    df = hot[1]
    plan = L.dedup(df, ["customer_key"], ("ts", "id"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_novelty_against_sets(spark):
    train, txn = split(spark, SF_DIR)
    members = B.members(train)
    sets: dict[tuple, set] = {}
    for r in members.collect():
        sets.setdefault((r["customer_key"], r["kind"]), set()).add(r["value"])
    values = B.set_values()
    rows = X.with_novelty(txn, members).select("customer_key", *[values[k].alias(f"v_{k}") for k in X.NOVELTY], *X.NOVELTY.values()).collect()
    for r in rows:
        for kind, name in X.NOVELTY.items():
            known = sets.get((r["customer_key"], kind), set())
            assert r[name] == float(bool(known) and r[f"v_{kind}"] is not None and r[f"v_{kind}"] not in known)
    assert len(rows) == txn.count()


def test_spread_of_large_amounts(spark):
    rows = [("a", 1e9 + (500 if i % 2 else -500), i) for i in range(40)] + [("b", 77.7, i) for i in range(5)]
    df = spark.createDataFrame(rows, "customer_key string, amount double, id long").withColumns(
        {"ts": F.lit("2024-01-01").cast("timestamp"), "version": F.lit(0)})
    got = {r["customer_key"]: r["amt_std"] for r in B.fit_baseline(df).collect()}
    assert got["a"] == pytest.approx(500, abs=1e-4) and got["b"] == 1.0


def test_ecdf_keeps_rows_without_a_score(spark):
    got = ecdf_rank(spark.createDataFrame([(1, 0.5), (2, None), (3, 0.7)], "id int, s double"), "s").collect()
    assert {r["id"]: r["ecdf"] for r in got} == {1: 0.5, 2: None, 3: 1.0}


@pytest.mark.parametrize("rows", [300, 5000])
def test_every_bag_is_full(spark, rows):
    bags = tree_samples(spark.range(rows), F.col("id"), 40, 256, 7, rows).groupBy("tree").agg(F.countDistinct("id").alias("n")).collect()
    assert len(bags) == 40 and {b["n"] for b in bags} == {256}


def test_rows_without_a_key_are_all_kept_in_one_pass(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 3)], "k string, v int")
    out = L.first_per_key(df, ["k"], [F.col("v")], keep_null_keys=True)
    assert sorted((r["k"] or "", r["v"]) for r in out.collect()) == [("", 3), ("", 3), ("a", 1)]
    assert out._jdf.queryExecution().executedPlan().toString().count("LogicalRDD") <= 1


def test_auc_with_ties(spark):
    pdf = pd.DataFrame({"y": [0, 0, 1, 1, 0, 1], "s": [0.1, 0.4, 0.4, 0.8, 0.8, 0.9]})
    df = spark.createDataFrame(pdf)
    pairs = [(a > b) + 0.5 * (a == b) for a in pdf.s[pdf.y == 1] for b in pdf.s[pdf.y == 0]]
    assert roc_auc(df, "y", "s").first()[0] == pytest.approx(np.mean(pairs))
    assert average_precision(df, "y", "s").first()[0] == pytest.approx(1 / 3 * 1.0 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 5)
    assert roc_auc(df.where("y = 0"), "y", "s").first()[0] is None


def test_dense_index_is_contiguous(spark):
    df = spark.range(5000).select(F.concat(F.lit("n"), "id").alias("node"))
    ids = [r["i"] for r in O.dense_index(df, "node", F.md5("node"), "i").collect()]
    assert sorted(ids) == list(range(5000))


def test_ranges_between_split_points_are_even(spark):
    """A million distinct scores within a hundredth of each other: no range holds twice the median, and results are exact."""
    n = 1_000_000
    scores = spark.range(n).select((0.5 + F.pmod(F.col("id") * 7919, F.lit(n)) / float(100 * n)).alias("s"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    sizes = [r["count"] for r in O.split(scores, "s", "test").groupBy("_bin").count().collect()]
    assert len(sizes) > O.PARTS * 0.9 and max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]
    got = O.quantiles(scores, "s", {"a": 0.25, "b": 0.5, "c": 0.999}).first()
    assert [got[k] for k in "abc"] == pytest.approx([0.5 + q * (n - 1) / (100 * n) for q in (0.25, 0.5, 0.999)], abs=1e-12)
    ranked = O.running_sums(scores, "s", ["y"]).agg(F.max("y_before"), F.max("y_total")).first()
    assert ranked[1] == (n + 2) // 3 and ranked[0] in (ranked[1], ranked[1] - 1)


def test_split_points_hold_any_values(spark):
    inf = float("inf")
    rows = [(float(x),) for x in [0, 0, -1, 1e-300, -1e300, 1e300, inf, -inf, 5, 5, 5]] + [(None,)]
    df = spark.createDataFrame(rows, "x double")
    points = O.split_points(df, "x", 8)
    got = {r["x"]: r["b"] for r in df.select("x", O.range_bin("x", points).alias("b")).collect() if r["x"] is not None}
    assert got == {x: sum(p <= x for p in points) for x in got}
    assert O.split_points(df.where("false"), "x") == [] and O.quantiles(df.where("false"), "x", {"m": 0.5}).first()[0] is None


def test_weighted_quantiles_of_one_amount_paid_often(spark):
    """A run of equal amounts is one row before anything is sorted, and the interpolation is that of its rows."""
    rng = np.random.default_rng(3)
    n = 20000
    amounts = np.where(rng.random(n) < 0.7, 50.0, rng.integers(1, 30, n) * 10.0)
    weights = rng.random(n)
    pdf = pd.DataFrame({"k": "hot", "amount": amounts, "w": weights, "t": np.arange(n)})
    got = O.weighted_quantiles(spark.createDataFrame(pdf), "amount", "w", {"a": 0.1, "b": 0.5, "c": 0.95}, ("k",), ("t",)).first()
    pdf = pdf.sort_values(["amount", "t"])
    mid = (pdf.w.cumsum() - pdf.w / 2) / pdf.w.sum()
    assert [got[k] for k in "abc"] == pytest.approx(list(np.interp([0.1, 0.5, 0.95], mid, pdf.amount)), abs=1e-9)


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_salted_join_splits_a_hot_key(spark):
    """70 % of the rows on one key, one in ten without a key: rows as from a plain join, parts of bounded size."""
    from habitus.operators.salted import hot_keys, salted_join

    rows = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 10 == 9, None).when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 900)).alias("k"))
    side = spark.createDataFrame([("hot", 1), ("c7", 2), ("unused", 3)], "k string, v int")
    got = salted_join(rows, side, "k", least=500)
    want = rows.join(side, "k", "left")
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert [(r.k, r._parts) for r in hot_keys(rows, "k", 500).collect()] == [("hot", 28)]
    assert hot_keys(rows, "k", 1, share=4).count() == 1  # never more keys than share


    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        sizes = [r[0] for r in salted_join(rows, side, "k", least=500).groupBy(F.spark_partition_id()).agg(F.count("*")).collect()]
        assert "SortMergeJoin" in final_plan(salted_join(rows, side, "k", least=500))
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert len(sizes) == 8 and max(sizes) < 2.5 * sorted(sizes)[4]  # one task would have 14,000 rows


def test_salted_join_of_nothing(spark):
    from habitus.operators.salted import salted_join

    rows = spark.createDataFrame([("a", 1)], "k string, id long")
    side = spark.createDataFrame([("a", True)], "k string, v boolean")
    assert salted_join(rows.limit(0), side, "k").count() == 0
    assert [tuple(r) for r in salted_join(rows, side.limit(0), "k").collect()] == [("a", 1, None)]
    assert [tuple(r) for r in salted_join(rows, side, "k", spread=()).collect()] == [("a", 1, True)]


def test_matrix_joins_the_customer_once(spark):
    """Beside the hourly summary of velocity, a row meets its customer in one join and its set members in one."""
    from habitus.plans.modelling import feature_matrix

    plan = feature_matrix(spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert len([l for l in plan.splitlines() if "Join LeftOuter" in l and "_salt" in l]) == 2
