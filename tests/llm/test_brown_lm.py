"""Class model: counts, base scores and scores by brute force, probabilities that sum to one, exchange that converges, ties."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from habitus.llm import brown_lm as B, queries
from tests.conftest import SF_DIR


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0D]+", lower) + [None]


def brute(docs):
    train = Counter(t for i, text in docs if zlib.crc32(str("" if i is None else i).encode()) % 10 for t in tokens(text))
    n, v = sum(train.values()), len(train)
    rows = {}
    for i, text in docs:
        ts = tokens(text)
        base = sum(math.log10((train[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)
        rows[i, text] = (len(ts), sum(train[t] > 0 for t in ts), n, base)
    return rows


@pytest.mark.parametrize("frequent, clustered", [(B.FREQUENT, B.CLUSTERED), (300, 100)])
def test_query_against_brute_force(spark, monkeypatch, frequent, clustered):
    monkeypatch.setattr(B, "FREQUENT", frequent)
    monkeypatch.setattr(B, "CLUSTERED", clustered)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    got, want = {r.doc_id: r for r in queries.QUERIES["op1_brown_lm"](spark, SF_DIR).collect()}, brute(docs)
    assert len(got) == len(docs)
    for (i, _), (n, known, total, base) in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    held = [r for r in got.values() if r.held_out]
    if frequent > 300:
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_score_against_brute_force(spark, monkeypatch):
    """Every token by hand from the fitted classes: clustered words, other known words, rare ones and unseen ones."""
    monkeypatch.setattr(B, "FREQUENT", 60)
    monkeypatch.setattr(B, "CLUSTERED", 40)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model, others = B.fit(df.filter("doc_id % 3 > 0").select("text"))
    known = {r.word: (r.n, r["class"]) for r in others.collect()}
    counts = Counter(t for i, text in docs if i % 3 for t in tokens(text))
    assert {w: n for w, (n, _) in known.items()} == {w: n for w, n in counts.items() if w is not None and symbol_of(model, w) >= 40}
    assert set(c for _, c in known.values()) <= set(range(B.CLASSES)) and len(set(c for _, c in known.values())) > 5
    assert np.allclose((10 ** model.transition).sum(axis=1), 1)
    classes = [(counts[w] if w in counts else 0, c) for w, c in [(w, final_class(model, known, w)) for w in counts if w is not None]]
    for c in range(B.CLASSES):  # with one outcome left for what the class has not shown
        assert sum(10 ** model.emission(n, g) for n, g in classes if g == c) + 10 ** model.emission(0, c) == pytest.approx(1)
    kinds = Counter()
    for r in B.score(df, model, others).collect():
        text, want, before = dict(docs)[r.doc_id], 0.0, B.END
        for t in tokens(text):
            c = B.END if t is None else final_class(model, known, t)
            kinds["end" if t is None else "unseen" if not counts[t] else "clustered" if symbol_of(model, t) < 40 else "other"] += 1
            want += model.transition[before, c] + model.emission(counts[t], c)
            before = None if t is None else int(model.classes[symbol_of(model, t)])
        assert r.score == pytest.approx(want, rel=1e-9)
    assert len(kinds) == 4 and min(kinds.values()) >= 50


def symbol_of(model, word):
    return int(B.symbols(B.Words([word.encode()]), model.table)[0][0])


def final_class(model, known, word):
    s = symbol_of(model, word)
    return known[word][1] if word in known else int(model.classes[s])


def sweeps(spark, sf):
    texts = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("text")
    table = B.frequent_table(B.word_counts(texts))
    pdf = B.bigram_counts(texts, table).toPandas()
    work = B.Exchange(pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["n"].to_numpy(float), int((table.index >= 0).sum()))
    return work, work.sweeps()


def test_exchange_converges(spark):
    """The likelihood never falls from sweep to sweep, and few words move in the last one."""
    work, done = sweeps(spark, "sf0.01")
    value = [v for v, _ in done]
    assert all(b >= a - 1e-6 for a, b in zip(value, value[1:])) and value[-1] - value[0] > 0.03 * abs(value[0])
    assert done[-1][1] <= 0.01 * work.clustered and len(done) > 2 and len(set(work.classes[:work.clustered].tolist())) > B.CLASSES // 2
    m = np.zeros((B.ALL, B.ALL))
    for w in range(work.clustered):  # the counts kept up to date are those of the classes
        m[work.classes[w]] += work.counts(w, work.after)
    rows = np.unique(work.classes[:work.clustered])
    assert np.allclose(m[rows], work.m[rows]) and work.likelihood() == pytest.approx((lambda m: B.xlogx(m).sum() - B.xlogx(m.sum(axis=0)).sum() - B.xlogx(m.sum(axis=1)).sum())(work.m))


def test_move_takes_the_best_class_of_all():
    rng = np.random.default_rng(1)
    words = 12
    pairs = rng.integers(0, 6, (words, words)).astype(float)
    a, b = np.repeat(np.arange(words), words), np.tile(np.arange(words), words)
    work = B.Exchange(a, b, pairs.ravel(), words, most=words)
    work.classes[:words] = rng.integers(0, 5, words)

    def value(classes):
        m = np.zeros((B.ALL, B.ALL))
        np.add.at(m, (classes[a], classes[b]), pairs.ravel())
        return B.xlogx(m).sum() - B.xlogx(m.sum(axis=0)).sum() - B.xlogx(m.sum(axis=1)).sum()

    work.m = np.zeros((B.ALL, B.ALL))
    np.add.at(work.m, (work.classes[a], work.classes[b]), pairs.ravel())
    work.x = B.xlogx(work.m)
    for w in range(words):
        trial = [value(np.where(np.arange(len(work.classes)) == w, c, work.classes)) for c in range(B.CLASSES)]
        work.move(w)
        assert value(work.classes) == pytest.approx(max(trial)) and work.likelihood() == pytest.approx(max(trial))


def test_even_counts_still_fill_the_table(spark):
    rows = [(" ".join(f"w{i}" for i in range(3000)), )]
    counts = B.word_counts(spark.createDataFrame(rows, "text string"))
    kept = B.most_frequent(counts, 500).count()
    assert 400 <= kept <= 500 and B.most_frequent(counts, 5000).count() == 3000


def test_awkward_rows(spark):
    docs = [(1, None), (2, ""), (3, "The the THE"), (3, "The the THE"), (None, "x"), (4, "z " * 20_000), (5, "y" * 50_000)]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, score double")
    got, want = B.held_out_scores(df).collect(), brute(docs)
    assert len(got) == 7
    for r in got:
        n, known, total, base = next(v for (i, _), v in want.items() if i == r.doc_id)
        assert (r.n_tokens, r.train_tokens) == (n, total) and r.base_score == pytest.approx(base)
    assert B.held_out_scores(df.limit(0)).count() == 0
