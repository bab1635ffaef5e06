"""Hard negatives: against brute force on scattered and on clustered vectors, work saved by the bounds, awkward rows."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from habitus.llm import hard_negatives as H, queries
from tests.conftest import SF_DIR

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """rows: (vec_id, components, label), one a vec_id; anchors are ids divisible by 50."""
    q = {i: ([math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows}
    dot = lambda a, b: sum(x * y for x, y in zip(q[a][0], q[b][0]))
    out = []
    for a in (i for i in q if i % 50 == 0):
        score = {b: dot(a, b) for b in q if b != a}
        first = lambda ids: sorted(ids, key=lambda b: (-score[b], b))
        for p in first(b for b in score if q[b][1] == q[a][1])[:5]:
            fits = first(b for b in score if q[b][1] != q[a][1] and 50 * score[p] <= 100 * score[b] <= 95 * score[p])
            out += [(a, p, k + 1, n, score[p], score[n]) for k, n in enumerate(fits[:3])]
    return sorted(out)


def mined(spark, rows):
    return sorted(tuple(r) for r in H.mine(H.vectors(spark.createDataFrame(rows, SCHEMA)), F.col("vec_id") % 50 == 0).collect())


def test_query_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in queries.QUERIES["op13_hard_negatives"](spark, SF_DIR).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("spread", [0.02, 0.5])
def test_small_blocks_and_one_hot_label(spark, monkeypatch, spread):
    monkeypatch.setattr(H, "BLOCK", 5)
    monkeypatch.setattr(H, "CHUNK", 40)
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i * 5, [c + rng.gauss(0, spread) for c in centres[i % 4]], 0 if rng.random() < 0.6 else rng.randrange(1, 4)) for i in range(300)]
    assert mined(spark, rows) == brute(rows)


def test_bounds_spare_work():
    rng = np.random.default_rng(5)
    centre = rng.integers(-200, 200, (8, 16))
    make = lambda n: (centre[rng.integers(0, 8, n)] + rng.integers(-3, 4, (n, 16))).astype(np.int32)
    a, c = make(60), make(500)
    order, parent, edge = H.spanning_tree(a)
    assert sorted(order) == list(range(60)) and np.allclose(edge[1:], [np.linalg.norm(a[o] - a[p]) for o, p in zip(order[1:], parent[1:])])
    lists = lambda m: pa.array(m.tolist(), pa.list_(pa.int32()))
    tree = H.with_tree(pa.table({"vec_id": np.arange(60), "q": lists(a)})).sort_by("place")
    anchors = tree.append_column("q", lists(a[tree["vec_id"].to_numpy()]))
    exact, share = a.astype(int) @ c.astype(int).T, []

    def visit(i, scores, middle, radius, keep):
        true = exact[tree["vec_id"][i].as_py()]
        assert ((true >= middle - radius) & (true <= middle + radius)).all()
        wanted = middle + radius >= H.kth(middle - radius, 5) if i else np.ones(500, bool)
        assert wanted[np.argsort(-true, kind="stable")[:5]].all()
        got = scores.settle(i, middle, radius, wanted, keep)
        assert (got[wanted] == true[wanted]).all()
        share.append(wanted.mean())

    H.walk(anchors, pa.table({"q": lists(c)}), visit)
    assert len(share) == 60 and np.mean(share) < 0.5


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.6, 0.0], 2), (3, [0.6, 0.0], 2), (4, [0.5, 0.5], 3), (50, [-1.0, 0.0], 1), (100, [2.0, 1.0], 9)]
    bad = [(5, None, 1), (6, [1.0, None], 2), (7, [nan, 1.0], 2), (8, [1.0, inf], 2), (9, [1.0, 1.0], None), (None, [1.0, 1.0], 2)]
    want = brute(good)
    assert want and mined(spark, good + bad) == want
    assert mined(spark, good + bad + good) == want  # repeated rows count once
    other = [(2, [0.7, 0.0], 4), (3, [0.6, 0.0], 1)]  # one id, two contents: the smaller label counts
    assert mined(spark, good + other) == brute([g for g in good if g[0] != 3] + [other[1]])
    uneven = [(0, [1.0], 1), (1, [1.0, 5.0, 5.0], 1), (2, [0.8, 3.0], 2), (3, [], 2)]
    assert mined(spark, uneven) == [(0, 1, 1, 2, 256 * 256, 256 * 204)]
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(0, [1.0], 1)]) == []
    huge = [(0, [1e30, 1.0], 1), (1, [1e30, 1.0], 1), (2, [5e4, 0.0], 2)]
    assert [r[:4] for r in mined(spark, huge)] == [(0, 1, 1, 2)]


def test_clashing_columns(spark):
    rows = [(0, [1.0], 1, 7, "x", 1, 2), (1, [1.0], 1, 7, "x", 1, 2), (2, [0.8], 2, 7, "x", 1, 2)]
    df = spark.createDataFrame(rows, SCHEMA + ", q int, kind string, block int, rank int")
    assert [tuple(r) for r in H.mine(H.vectors(df), F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2, 65536, 256 * 204)]
