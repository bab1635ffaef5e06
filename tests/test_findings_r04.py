"""Ties that SQL leaves open, what the driver keeps, and what the model queries store."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from habitus.config import FEATURES
from habitus.operators import baseline as B, ensemble as E, features as X, graph as G, monitor as M
from habitus.plans import modelling as P, training as T

SMALL = "/root/testdata/sf0.001"


def test_of_verdicts_of_one_time_the_first_counts(spark, tmp_path):
    """As DuckDB answers the SQL of o20, on events whose times are equal in pairs."""
    import __spark_entry__ as entry
    from tests.oracle import TABLES, compare, connect

    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"{SMALL}/{t}.parquet")
    (tmp_path / "events.parquet").unlink()
    con = connect(SMALL)
    con.execute(f"COPY (SELECT * REPLACE (TIMESTAMP '2024-01-01' + to_minutes(event_id // 2) AS ts) FROM events ORDER BY event_id) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = entry.queries()["o20_linked_feedback"](spark, str(tmp_path)).toPandas()
    assert compare(got, connect(tmp_path).execute(entry.oracle_sql()["o20_linked_feedback"]).df()) is None


def test_verdicts_without_a_tie_column_keep_their_order(spark):
    v = spark.createDataFrame([("t", "Legit", 1), ("t", "BAD", 1)], "transaction_id string, verdict string, created_at int")
    d = spark.createDataFrame([], "transaction_id string, entity_key string, decision string, scored_at int, id int")
    old = d.select("transaction_id", "entity_key", "decision", F.lit("genuine").alias("verdict"))
    assert [r["verdict"] for r in M.link_feedback(v, d, old).collect()] == ["genuine"]
    tied = v.withColumn("n", F.when(F.col("verdict") == "BAD", 0).otherwise(1))
    assert [r["verdict"] for r in M.link_feedback(tied, d, old, ("n",)).collect()] == ["fraud"]


def test_the_matrix_of_rows_that_move_once_is_the_one_of_transform(spark):
    kept = tuple(c for c in T.BASE_COLS if not c.startswith("pop_"))
    train, future = P.split(spark, SMALL, *P.MATRIX_COLUMNS, "transaction_id")
    base, members, population, graph = B.fit_baseline(train).localCheckpoint(), B.members(train).localCheckpoint(), B.population_baseline(train), G.graph_features(train).localCheckpoint()
    table = lambda df: df.toPandas().set_index("transaction_id").sort_index()
    want = [table(X.transform(rows, base, members, population, graph, T.BASE_COLS)) for rows in (train, future)]
    assert len(want[1]) > 500 and want[1].is_cold_start.nunique() == 2
    rows = T.materialize(P.labelled(spark, SMALL).select("transaction_id", "bad", *dict.fromkeys(P.MATRIX_COLUMNS)), "labelled")
    for whole in (100_000, 30):
        past, later, edges = X.learned_matrix(rows, F.expr(P.CUT), ("bad", *kept), whole=whole, **P.FIXTURE_ML)
        for got, old, more in ((table(past), want[0], ("amount",)), (table(later), want[1], T.BASE_COLS)):
            cols = [*FEATURES, *more]
            assert (got.index == old.index).all() and (got.is_cold_start == old.is_cold_start).all()
            assert np.allclose(got[cols].astype(float), old[cols].astype(float), rtol=1e-9, atol=1e-9, equal_nan=True)
        assert {tuple(r) for r in edges.select("customer_key", "destination_account_no", "n").collect()} == {tuple(r) for r in G.edge_counts(train).collect()}
        assert table(later)["bad"].to_dict() == {r["transaction_id"]: r["bad"] for r in rows.where(f"ts >= {P.CUT}").select("transaction_id", "bad").collect()}


def test_rows_move_once_for_all_their_features(spark):
    rows = P.labelled(spark, SMALL).withColumns({"later": F.col("ts") >= F.expr(P.CUT), "_learned": ~F.col("bad"), "cross_border": X.cross_border()} | X.novelty_values())
    known = rows.select("customer_key", "transaction_id", "ts", "amount", "id", "version", "later", "_learned", "cross_border", *X.novelty_values()).localCheckpoint().repartition("customer_key")
    made = X.beside(known, X.Window.partitionBy("customer_key"), F.expr(P.CUT), 90.0)
    made.collect()
    moved = [line for line in made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines() if "Exchange" in line]
    assert len(moved) == 1 and "hashpartitioning(customer_key" in moved[0]


def test_reconstruction_errors_need_no_other_detector(spark):
    kept = dict(T._SHARED)
    T._SHARED.clear()
    try:
        alone = T.m04(spark, SMALL).orderBy("transaction_id").collect()
        assert {"matrices", "reconstruction"} == {name for store in T._SHARED.values() for name in store}
        whole = E.raw_scores(T.matrices(spark, SMALL)[1], T.model(spark, SMALL)[0])
        assert alone == whole.select("transaction_id", F.round("ae_raw", 6).alias("error"), "autoencoder").orderBy("transaction_id").collect()
    finally:
        T._SHARED.update(kept)


def test_holdout_customers_are_outside_of_the_graph(spark):
    model, holdout = T.model(spark, SMALL)
    held = holdout.select("customer_key").distinct()
    assert held.count() > 0 and model.graph.join(held, "customer_key").count() == 0
    assert {r["gnn"] for r in holdout.select("gnn").distinct().collect()} == {0.5}


def test_the_audit_reads_what_was_learned_from_its_rows(spark):
    made = T.o14(spark, SMALL)
    learned = {r["customer_key"]: (r["m"], r["x"]) for r in T.matrices(spark, SMALL)[1].select("customer_key", F.round("amt_median", 2).alias("m"), F.round("amt_max", 2).alias("x")).collect()}
    rows = made.select("customer_key", "amount.learned_median", "amount.learned_max").collect()
    assert rows and all(learned[r[0]] == (r[1], r[2]) for r in rows)


def test_no_plan_of_an_answer_holds_the_joins_behind_its_history(spark, monkeypatch):
    from habitus.operators import asof, serving
    from habitus.plans import serving as Q

    texts = {}
    for module in (asof, serving):
        def seen(df, label, keep=module.materialize):
            texts[label] = df._jdf.queryExecution().optimizedPlan().toString()
            return keep(df, label)
        monkeypatch.setattr(module, "materialize", seen)
    Q.m12_requests(spark, SMALL).count()
    assert {"totals", "medians", "seen-amounts", "request-features"} <= set(texts)
    assert not [label for label, text in texts.items() if "l_orderkey" in text]
    assert not {"totals", "medians"} & {label for label, text in texts.items() if text.count("Relation") > 6}


def test_medians_before_a_moment_of_few_and_of_many_rows(spark):
    import pandas as pd
    from habitus.operators.asof import as_of_median

    rng = np.random.default_rng(9)
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 3 * 86_400, 400), unit="s")
    pdf = pd.DataFrame({"customer_key": rng.integers(0, 3, 400).astype(str), "ts": at, "amount": rng.integers(1, 40, 400) / 4})
    probes = pdf.sample(60, random_state=1).assign(probe_id=[f"p{i}" for i in range(60)])
    day = pd.Timedelta(hours=24)
    want = {p.probe_id: np.median([p.amount, *pdf.amount[(pdf.customer_key == p.customer_key) & (pdf.ts < p.ts) & (pdf.ts >= p.ts - day)]]) for p in probes.itertuples()}
    for most in (100_000, 20, 1):
        got = as_of_median(spark.createDataFrame(pdf), spark.createDataFrame(probes), most=most).collect()
        assert {r["probe_id"]: r["median"] for r in got} == want
