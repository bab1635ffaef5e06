"""Importance resampling: weights by brute force, exact selection, quality of the selection."""

import random

import numpy as np
from pyspark.sql import functions as F

from habitus.llm import importance as I, queries
from habitus.llm.text import Words, mix
from tests.conftest import SF_DIR


def test_kth_largest(spark):
    rng = random.Random(4)
    values = [rng.choice([rng.random(), 0.25, -3.0, rng.random() * 1e-12]) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 37, 999, 1500, 2000):
        assert I.kth_largest(df, "v", k) == ordered[k - 1]


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").toPandas()
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").toPandas()
    good = set(labels[(labels.quality == 1) & (labels.toxic == 0)].doc_id)

    def grams(text):
        w = (text or "").encode().split()
        h = Words([b" ".join(w)]).hash if w else np.empty(0, np.uint64)
        pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        return [int(x) >> 48 for x in mix(h)] + [int(x) >> 48 for x in mix(mix(pairs) ^ np.uint64(0x5851F42D4C957F2D))]

    of = {i: grams(t) for i, t in zip(docs.doc_id, docs.text)}
    count = lambda ids: np.bincount([g for i in ids for g in of[i]], minlength=1 << 16) + 1.0
    p, q = count([i for i in of if i in good]), count(of)
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    got = queries.QUERIES["op2_importance"](spark, SF_DIR).toPandas().set_index("doc_id")
    assert sorted(got.index) == sorted(of)
    for i, g in of.items():
        want = 128 * sum(ratio[x] for x in g) / max(1, len(g))
        assert abs(got.log_weight[i] - want) < 1e-6 * max(1, abs(want)) and got.n_grams[i] == len(g)
    k = round(len(of) * len(good) / len(labels))
    assert got.selected.sum() == k and got[got.selected].gumbel_key.min() > got[~got.selected].gumbel_key.max()


def test_selection_prefers_good_texts(spark):
    got = queries.QUERIES["op2_importance"](spark, SF_DIR.replace("0.001", "0.01")).toPandas()
    labels = spark.read.parquet(SF_DIR.replace("0.001", "0.01") + "/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    good = (both.quality == 1) & (both.toxic == 0)
    assert both[good].selected.mean() > both[~good].selected.mean() + 0.3


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c"), (4, "x " * 50_000)]
    docs = spark.createDataFrame([(i, t, True) for i, t in rows], "doc_id long, text string, selected boolean")
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, None), (4, 0, 0), (4, None, 1), (None, 1, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    got = I.resample(docs, labels).collect()
    assert len(got) == 6 and {r.log_weight for r in got if r.doc_id in (1, 2)} == {0.0}
    assert len({r.selected for r in got if r.doc_id == 3}) == 1 and sum(r.selected for r in got) in (2, 3)
    assert I.resample(docs.limit(0), labels).count() == 0
    assert I.resample(docs, labels.limit(0)).filter("selected").count() == 0
    assert I.resample(docs, labels, share=1.0).filter("selected").count() == 6
