"""What is stored and shuffled per row, and the exact forms of steps that were made smaller."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from habitus.functions import addresses as A
from habitus.operators import detectors as D, evaluate as E, filters as L, ordered as O
from habitus.operators.forest import Forest, grow_tree
from habitus.plans import modelling as M

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_an_order_are_made_unique_where_they_are(spark):
    assert "hashpartitioning(transaction_id" not in plan(M.labelled(spark, SMALL))


def test_only_the_columns_of_the_query_are_stored(spark):
    train, future = M.split(spark, SMALL, *M.SETS)
    assert set(train.columns) == set(M.SETS) and set(future.columns) == {*M.SETS, "transaction_id"}
    assert set(M.training(spark, SMALL, *M.AMOUNTS).columns) == set(M.AMOUNTS)


def test_weighted_spread_is_taken_around_the_mean(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.integers(0, 5, 400), "x": 1e6 + rng.integers(0, 50, 400) / 100, "w": rng.random(400)})
    got = O.weighted_quantiles(spark.createDataFrame(pdf), "x", "w", {"m": 0.5}, ("k",), spread="s").toPandas().set_index("k")["s"]
    for k, g in pdf.groupby("k"):
        mean = np.average(g.x, weights=g.w)
        assert abs(got[k] - np.sqrt(np.average((g.x - mean) ** 2, weights=g.w))) < 1e-8


def test_quartiles_from_values_near_them_are_exact(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"a": rng.normal(size=12_000), "b": (rng.random(12_000) < 0.3).astype(float), "c": np.repeat(7.0, 12_000), "d": rng.integers(0, 9, 12_000).astype(float)})
    df, cols = spark.createDataFrame(pdf).cache(), list(pdf.columns)
    scaler = D.fit_scaler(df, cols, least=1000)
    low, middle, high = np.quantile(pdf.to_numpy(), [0.25, 0.5, 0.75], axis=0)
    assert np.allclose(scaler.median, middle, rtol=0, atol=1e-12) and np.allclose(scaler.scale, np.where(high > low, high - low, 1.0), rtol=0, atol=1e-12)
    spans = D.quartile_spans(df, ["a"], 1000)["a"]
    kept = df.select(D.between_spans(F.col("a"), spans).alias("v")).distinct().count()
    assert kept < 12_000 / 50


def test_trees_walked_one_by_one_give_the_scores_of_single_rows():
    rng = np.random.default_rng(5)
    trees = [grow_tree(rng.normal(size=(n, 3)), np.random.default_rng(n)) for n in (1, 2, 64, 64)]
    width = max(len(t["feature"]) for t in trees)
    pad = lambda c, fill, kind: np.array([t[c] + [fill] * (width - len(t[c])) for t in trees], dtype=kind)
    forest = Forest(pad("feature", -1, np.int32), pad("threshold", 0.0, float), pad("left", 0, np.int32), pad("right", 0, np.int32), pad("length", 0.0, float), 64.0)
    x = rng.normal(size=(200, 3))

    def walk(t, row):
        at = 0
        while trees[t]["feature"][at] >= 0:
            at = trees[t]["left" if row[trees[t]["feature"][at]] <= trees[t]["threshold"][at] else "right"][at]
        return trees[t]["length"][at]

    from habitus.operators.forest import harmonic_length
    want = [2.0 ** (-np.mean([walk(t, row) for t in range(4)]) / float(harmonic_length(64.0))) for row in x]
    assert np.allclose(forest.raw_scores(x), want, rtol=0, atol=1e-15)


def test_the_holdout_rule_marks_the_customers_of_the_split(spark):
    keys = spark.range(500).select(F.concat(F.lit("c"), "id").alias("customer_key"))
    rule = E.holdout_rule(keys, 0.2, 42)
    split = {r["customer_key"]: r["holdout"] for r in E.split_customers(keys, 0.2, 42).collect()}
    assert {r["customer_key"]: r["h"] for r in keys.select("customer_key", rule.alias("h")).collect()} == split and sum(split.values()) == 100


def test_rows_without_an_address_are_spread(spark):
    ranges = A.ranges_of(spark.createDataFrame([("41.0.0.0/8", 1)], "network string, v int"), network="network")
    rows = spark.range(1000).select("id", F.when(F.col("id") < 10, "41.1.2.3").alias("ip"))
    out = A.with_ranges(rows, ranges, "ip", ("v",))
    assert "_salt" in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.where("v = 1").count() == 10 and out.count() == 1000


def test_quartiles_are_counted_beside_the_rows(spark):
    x = np.concatenate([np.random.default_rng(6).normal(size=500), [np.nan, -0.0, np.inf, -np.inf]])
    spans = [(-0.7, -0.6), (-0.1, 0.1), (0.6, 0.7)]
    df = spark.createDataFrame(pd.DataFrame({"a": x}))
    want = [r["v"] for r in df.select(D.between_spans(F.col("a"), spans).alias("v")).collect()]
    assert np.array_equal(D.clipped(x, spans), want, equal_nan=True)
    assert "MapInArrow" in plan(D.near_quartiles(df, ["a"], {"a": spans})) and "Generate" not in plan(D.near_quartiles(df, ["a"], {"a": spans}))


def test_reconstruction_is_the_principal_subspace_in_one_pass(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 5)) @ rng.normal(size=(5, 5)) + 3
    cols = list("abcde")
    found = D.fit_reconstruction(spark.createDataFrame(pd.DataFrame(x, columns=cols)), cols, 2)
    basis = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:2].T
    assert np.allclose(found.mean, x.mean(axis=0), rtol=0, atol=1e-12) and np.allclose(found.basis @ found.basis.T, basis @ basis.T, rtol=0, atol=1e-9)


def test_rows_move_to_their_answers_without_their_values(spark):
    train, future = M.split(spark, SMALL, *M.SETS)
    from habitus.operators import baseline as B, features as X
    moved = X.with_novelty(future, B.members(train)).select("transaction_id", *X.NOVELTY.values())
    lines = [line for line in moved._jdf.queryExecution().optimizedPlan().toString().splitlines() if "_asked" in line and "Project" in line]
    assert lines and not [line for line in lines if "customer_location" in line and "_may_locs" not in line and "_salt" in line]


def test_text_stays_behind_when_rows_move_for_their_features(spark):
    from habitus.operators import features as X
    rows = X.with_questions(M.split(spark, SMALL, *M.MATRIX_COLUMNS)[1].withColumn("cross_border", X.cross_border()))
    assert "_asked" in rows.columns and not [c for c in rows.columns if c.startswith("_v_")]
    moved = [line for line in M.feature_matrix(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "_shift" in line and "_row" in line]
    assert moved and not [line for line in moved if any(f"{c}, " in line.split("AS _row")[0] for c in ("customer_location", "customer_ip_address"))]


def test_cold_start_rows_leave_the_others_behind(spark):
    train, future = M.split(spark, SMALL, *M.MATRIX_COLUMNS, learned=M.AMOUNTS)
    assert set(train.columns) == set(M.AMOUNTS) and set(M.MATRIX_COLUMNS) <= set(future.columns)
    made = M.x05(spark, SMALL)
    assert any("/cold-" in f for f in made.inputFiles()) and "_h23" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_small_groups_move_once(spark):
    train = M.training(spark, SMALL, *M.AMOUNTS)
    rows = train.withColumn("w", F.col("amount"))
    for got in (O.weighted_quantiles(rows, "amount", "w", {"m": 0.5}, ("customer_key",)), O.quantiles(train, "amount", {"m": 0.5}, ("customer_key",), stored=True)):
        got.collect()
        final = plan(got).split("Initial Plan")[0]
        moved = [line for line in final.splitlines() if "Exchange" in line]
        assert len(moved) == 1 and "REPARTITION_BY_COL" in moved[0] and "hashpartitioning(customer_key" in moved[0]


def test_small_and_large_groups_have_the_same_quantiles(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"k": np.r_[np.zeros(900), rng.integers(1, 40, 600)].astype(int), "x": rng.integers(0, 300, 1500) / 4 - 20, "w": rng.random(1500)})
    df = spark.createDataFrame(pdf)
    at = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}
    for stored in (False, True):
        for whole in (1, 100, 100_000):
            got = O.quantiles(df, "x", at, ("k",), stored=stored, whole=whole).toPandas().set_index("k")
            assert all(np.allclose(got.loc[k, list(at)].astype(float), g.x.quantile(list(at.values()))) for k, g in pdf.groupby("k"))
    found = [O.weighted_quantiles(df, "x", "w", {"a": 0.1, "b": 0.5, "c": 0.95}, ("k",), spread="s", whole=n).toPandas().set_index("k").sort_index() for n in (1, 100, 100_000)]
    assert len(found[0]) == pdf.k.nunique() and all(np.allclose(found[0], other, rtol=1e-10) for other in found[1:])


def test_profiles_store_only_what_their_query_reads(spark):
    from habitus.operators import profile as P
    from habitus.plans import profiling as R
    unique, clean = R.stored_history(spark, SMALL, "ts", "amount")
    assert set(unique.columns) == {"entity_key", "ts", "amount", "status", "is_blocked", "sender_blacklisted"}
    for made, gone in ((R.j02, {"origin_country", "customer_name", "customer_ip_address"}), (R.a26, {"merchant_name", "customer_name", "transaction_type"})):
        stored = {c for f in made(spark, SMALL).inputFiles() for c in spark.read.parquet(f).columns}
        assert "amount" in stored and not stored & gone
    rows = R.history(spark, SMALL)[0].where("branch_id < 6").localCheckpoint()
    own = L.strict_clean(rows)
    whole = P.build_profiles(own, rows, P.newest(own), cfg=R.GATE)
    part = P.build_profiles(own, rows, P.newest(own), cfg=R.GATE, kinds=("city", "beneficiary", "merchant"), attributes=False)
    names = [c for c in part.columns if c not in P.MAP_NAMES.values() and not c.startswith("peak_") and c in whole.columns]
    want = {r["entity_key"]: r for r in whole.collect()}
    assert {"last_city", "confidence_score", "known_ip_subnets"} <= set(whole.columns) and "confidence_score" not in part.columns
    for r in part.collect():
        w = want[r["entity_key"]]
        assert all(r[c] == w[c] or abs(r[c] - w[c]) < 1e-6 for c in names) and r["usual_merchants"] == w["usual_merchants"] and r["beneficiaries"] == w["beneficiaries"]
    gaps = own.withColumns({
        "customer_location": F.when(F.xxhash64("entity_key") % 3 != 0, F.col("customer_location")), "origin_country": F.when(F.xxhash64("entity_key") % 5 != 0, F.col("origin_country")),
        "destination_account_no": F.when(F.xxhash64("entity_key") % 7 != 0, F.col("destination_account_no")), "customer_ip_address": F.when(F.xxhash64("entity_key") % 4 != 0, F.lit(""))})
    full = {r["entity_key"]: r["confidence_score"] for r in P.build_profiles(gaps, rows, P.newest(gaps), cfg=R.GATE).collect()}
    assert {r["entity_key"]: r["confidence_score"] for r in P.confidences(gaps, P.newest(gaps), cfg=R.GATE).collect()} == full and len(set(full.values())) > 5


def test_lines_move_once_and_without_their_flags(spark):
    from habitus.sources import tables as T
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(T.transactions(spark, SMALL, T.ORDERED))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "hashpartitioning(l_suppkey" not in text and "hashpartitioning(l_orderkey" in text
    joined = T.transactions(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in joined.splitlines() if "AS _suspicious" in line] and not [line for line in joined.splitlines() if "l_discount" in line and "Join" in line]


def test_changes_of_sets_are_counted_in_one_pass(spark):
    from habitus.operators import baseline as B
    train, was = M.training(spark, SMALL, *M.SETS), F.expr("ts < TIMESTAMP '1997-01-01'")
    late = train.groupBy("customer_key").agg(F.max("ts").alias("m")).where("m >= TIMESTAMP '2000-06-01'")
    rows = lambda df: sorted(tuple(r) for r in df.select("customer_key", "kind", "added", "removed", "kept").collect())
    for current, now in ((None, train), (late, train.join(late, "customer_key", "left_semi"))):
        assert rows(B.set_changes_since(train, was, current=current)) == rows(B.set_changes(B.members(train.where(was)), B.members(now)))
    made = B.set_changes_since(train, was)
    made.collect()
    assert len([line for line in plan(made).split("Initial Plan")[0].splitlines() if "Exchange" in line]) == 1


def test_novelty_is_found_beside_rows_that_move_once(spark):
    from habitus.operators import baseline as B, features as X
    cut, gate = F.expr("TIMESTAMP '1998-01-01 00:00:00'"), {"min_txns": 20, "min_days": 30}
    rows = M.labelled(spark, SMALL).select("transaction_id", "bad", *M.SETS)
    blank = lambda c, n: F.when(F.xxhash64("transaction_id") % n != 0, F.col(c))
    rows = rows.withColumns({c: blank(c, n) for c, n in (("customer_location", 3), ("origin_country", 4), ("transaction_type", 5), ("customer_ip_address", 7))})
    rows = rows.withColumn("destination_account_no", F.when(F.col("customer_key").cast("int") % 3 != 0, F.col("destination_account_no"))).localCheckpoint()
    clean = rows.where("NOT bad")
    train = L.only_eligible(clean, L.ml_eligible(clean, **gate)).where(F.col("ts") < cut)
    found = lambda df: sorted(tuple(r) for r in df.select("transaction_id", *X.NOVELTY.values()).collect())
    want = found(X.with_novelty(rows.where(F.col("ts") >= cut), B.members(train)))
    assert len(want) > 100 and all(len({r[i] for r in want}) == 2 for i in (1, 3, 4, 5))
    for whole in (1, 30, 100_000):
        assert found(X.novelty_since(rows, cut, whole=whole, **gate)) == want
    made = M.x03(spark, SMALL)
    made.collect()
    moved = [line for line in plan(made).split("Initial Plan")[0].splitlines() if "Exchange" in line]
    assert len(moved) == 1 and "REPARTITION_BY_COL" in moved[0] and "hashpartitioning(customer_key" in moved[0]


def test_shown_sets_are_found_from_rows_that_move_once(spark):
    from habitus.operators import baseline as B
    rows = M.stored_clean(spark, SMALL, *M.SHOWN)
    gaps = rows.withColumn("customer_location", F.when(F.col("customer_key").cast("int") % 3 != 0, F.col("customer_location"))).withColumn("origin_country", F.lit("x"))
    seen = B.members(gaps)
    want = B.set_sizes(seen).join(B.member_arrays(seen, ["locs", "types"]), "customer_key").select("customer_key", "n_locs", "n_benefs", "n_ips", "locs", "types")
    found = lambda df: sorted(tuple(r) for r in df.collect())
    for whole in (1, 30, 100_000):
        assert found(B.set_summaries(gaps, ("locs", "benefs", "ips"), ("locs", "types"), whole=whole)) == found(want)
    made = B.set_summaries(rows, ("locs", "benefs", "ips"), ("locs", "types"))
    made.collect()
    assert len([line for line in plan(made).split("Initial Plan")[0].splitlines() if "Exchange" in line]) == 1
    stored = {c for f in M.x25(spark, SMALL).inputFiles() for c in spark.read.parquet(f).columns}
    assert {"customer_location", "amount"} <= stored and "origin_country" not in stored
