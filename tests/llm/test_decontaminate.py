"""Decontamination against brute force, on planted passages and awkward rows."""

import hashlib
import random
import re

from habitus.llm import decontaminate as D


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s:s + n]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s:s + n])) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[k]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, hits string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, key int")
    return sorted((tuple(r) for r in D.decontaminate(d, b).drop("items").collect()), key=str)


def test_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(6)] + ["É", "7x", "the"]
    draw = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "!"]) for _ in range(n))
    items = [(i, draw(rng.randrange(0, 25))) for i in range(12)] + [(50, "The THE the the the the the the the the the"), (51, "w1 É"), (52, "...")]
    items += [(60, items[5][1]), (None, items[6][1]), (61, None), (61, None)]
    docs = []
    for i in range(120):
        text = draw(rng.randrange(0, 60))
        if i % 3 == 0:
            text += " " + rng.choice(items[:12])[1].upper() + " " + draw(3)
        docs.append((i, text))
    docs += [(200, None), (201, ""), (202, "the " * 3000), (203, items[3][1]), (203, items[3][1]), (None, items[4][1])]
    assert run(spark, docs, items) == brute(docs, items)


def test_no_short_item(spark):
    rng = random.Random(2)
    draw = lambda n: " ".join(str(rng.randrange(3)) for _ in range(n))
    items = [(i, draw(14)) for i in range(4)]
    docs = [(i, draw(40) + " " + items[i % 4][1][: rng.randrange(29)]) for i in range(200)]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [(1, "a b")], []) == brute([(1, "a b")], [])
    assert run(spark, [], [(1, "a b")]) == []
