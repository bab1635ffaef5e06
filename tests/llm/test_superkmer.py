"""Repeated passages against brute force: planted copies, runs of one word, hash collisions, awkward rows."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from habitus.llm import superkmer as S
from habitus.llm.text import Words


def brute(docs, window):
    seen, gone, words = {}, set(), {}
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        w = words[doc_id] = [x for x in "".join(" " if c in " \t\n\v\f\r" else c for c in text or "").split(" ") if x]
        for s in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[s:s + window]), (doc_id, s)) != (doc_id, s):
                gone |= {(doc_id, p) for p in range(s, s + window)}
    out = []
    for doc_id, w in words.items():
        kept = [v for p, v in enumerate(w) if (doc_id, p) not in gone]
        out.append((doc_id, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


def make(seed, n):
    rng = random.Random(seed)
    draw = lambda k: "".join(rng.choice(["a", "b", "é", "d1", "x"]) + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(k))
    passages = [draw(k) for k in (5, 9, 30, 70)]
    docs = [(i, draw(rng.randrange(25)) + rng.choice(passages) + draw(rng.randrange(25))) for i in rng.sample(range(10 * n), n)]
    return docs + [(-1, None), (-2, ""), (-3, "same " * 500), (-4, "same " * 90), (-5, " \n ")]


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_WORDS", 200)
    for seed, window in ((1, 6), (2, 20)):
        docs = make(seed, 150)
        df = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, mark string").repartition(7)
        got = sorted(tuple(r)[:4] for r in S.dedup(df, window=window).collect())
        assert got == brute(docs, window)


def test_common_runs_go_last(spark, monkeypatch):
    monkeypatch.setattr(S, "COMMON", 16)
    monkeypatch.setattr(S, "BUCKET_WORDS", 200)
    docs = [(i, f"u{i} v{i} " + "one two three four five six seven eight " * 2 + f"w{i}") for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    common, words = S.common_runs(df, 3)
    assert words == sum(len(t.split()) for _, t in docs) and 0 < len(common) <= 16
    assert sorted(tuple(r)[:4] for r in S.dedup(df, window=8).collect()) == brute(docs, 8)
    packed = S.pack(df.withColumn("mark", F.lit(0)).selectExpr("doc_id AS doc", "cast(mark as long) AS mark", "text"), common, 50, 8, 3)
    by = packed.filter("packed IS NOT NULL").groupBy("bucket").agg(F.sum(F.size("doc")).alias("n")).toPandas()["n"]
    assert by.max() < 0.35 * by.sum()


def test_equal_hashes_are_told_apart():
    words = Words([b"a b c", b"a b c", b"x y z", b"x y z"])
    at = np.array([0, 3, 6, 9])
    assert S.first_of(words, at, np.zeros(4, np.uint64), 3).tolist() == [0, 0, 2, 2]


def test_awkward_rows(spark):
    text = " ".join(map(str, range(40)))
    rows = [(1, text), (1, text), (None, text), (2, None), (2, "z " + text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in S.dedup(df).collect())
    assert got == [(0, 40, 0), (1, 40, 40), (1, 40, 40), (2, 0, 0), (2, 41, 40)]
    assert S.dedup(df.limit(0)).count() == 0
