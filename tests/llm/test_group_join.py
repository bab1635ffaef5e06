"""Similarity components against brute force: families of near copies, borderline pairs, awkward rows."""

import random

import numpy as np
import pytest

from habitus.llm import group_join as G
from habitus.llm.components import components


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * inter >= 85 * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (doc_id, _), x in zip(docs, label):
        if doc_id is not None:
            least[x] = min(least.get(x, doc_id), doc_id)
    return sorted(((i, len(s), i if not s else least.get(x)) for (i, _), s, x in zip(docs, sets, label)), key=str)


def run(spark, docs):
    df = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, row int").repartition(6)
    return sorted((tuple(r) for r in G.link_components(df).collect()), key=str)


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        at = rng.randrange(len(w))
        w[at:at + rng.choice([0, 1, 1])] = [f"e{rng.randrange(10**6)}"]
    return " ".join(w)


def family_docs(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    docs, ids = [], iter(rng.sample(range(10_000), 900))
    passage = [word() for _ in range(55)]
    for size, edits in ((150, 1), (60, 3), (40, 6), (25, 9)):
        base = [word() for _ in range(rng.choice([60, 120, 200]))]
        docs += [(next(ids), edited(rng, base, rng.randrange(edits + 1))) for _ in range(size)]
    for _ in range(120):
        own = [word() for _ in range(rng.randrange(1, 150))]
        docs.append((next(ids), " ".join(own[:20] + passage + own[20:])))
    for _ in range(80):  # cut and grown texts, near the size bound
        own = [word() for _ in range(100)]
        docs.append((next(ids), " ".join(own)))
        docs.append((next(ids), " ".join(own[: rng.randrange(82, 101)])))
    for _ in range(60):
        docs.append((next(ids), " ".join(rng.choice(["a", "B", "c"]) for _ in range(rng.randrange(8)))))
    return docs


@pytest.mark.parametrize("seed, part", [(1, 64), (2, 4)])
def test_brute_force(spark, monkeypatch, seed, part):
    monkeypatch.setattr(G, "PART", part)
    monkeypatch.setattr(G, "QUERIES", part)
    docs = family_docs(seed)
    assert run(spark, docs) == brute(docs)


def test_second_step_alone_finds_all_links(spark, monkeypatch):
    monkeypatch.setattr(G, "first_links", lambda alike, *rest: alike.sparkSession.createDataFrame([], "a long, b long"))
    docs = family_docs(3)
    assert run(spark, docs) == brute(docs)


def test_awkward_rows(spark):
    long = " ".join(f"x{i}" for i in range(500))
    docs = [(1, None), (2, ""), (3, " \n"), (4, "One Two"), (5, "one  two"), (5, "one two"), (6, "one"), (None, long), (None, long + " y"), (9, None),
            (7, "a b c d"), (8, "A b C d"), (8, "different words in here")]
    assert run(spark, docs) == brute(docs)
    assert run(spark, []) == []


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 2000 + i) for i in range(300)] + [(5000, 5001), (5001, 5000), (7, 7)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(1, 61)}, **{2000 + i: 1000 for i in range(300)}, 5001: 5000}
