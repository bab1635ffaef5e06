"""Language identification: held-out accuracy, backoff, the cases without letters."""

import math
import re
import zlib
from collections import Counter
from functools import cache

import numpy as np

from habitus.llm import language_id as L, queries
from habitus.llm.text import Words, mix
from tests.conftest import SF_DIR


def test_held_out_accuracy(spark):
    got = queries.QUERIES["op6_language_id"](spark, SF_DIR).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang", "text").toPandas().set_index("doc_id")
    assert sorted(got.index) == sorted(docs.index)
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.index]).all()
    held = got[got["held_out"]]
    assert (held["lang_pred"] == docs["lang"].reindex(held.index)).mean() > 0.95 and got["score"].between(0, 1).all()


def test_backoff_and_undetermined(spark):
    rows = [(1, "the house and the garden", "en"), (2, "das haus und der garten", "de"), (3, "x", None), (4, None, "en")] * 3
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en"]
    asked = [(1, "the"), (2, "und"), (3, "gartens"), (4, "housing"), (5, None), (6, ""), (7, "12 — !"), (8, "字"), (8, "字"), (None, "THE"), (9, "the " * 50_000)]
    got = {(r.doc_id, r.lang_pred): r.score for r in L.predict(spark.createDataFrame([(i, t, "x") for i, t in asked], "doc_id long, text string, lang_pred string"), model).collect()}
    assert {(1, "en"), (2, "de"), (3, "de"), (4, "en"), (5, "und"), (6, "und"), (7, "und"), (None, "en"), (9, "en")} <= set(got)
    assert {k[1] for k in got if k[0] == 8} <= {"en", "de"} and got[5, "und"] == 0


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in L.held_out_predictions(docs).select("doc_id", "lang_pred", "score").collect()] == [(1, "und", 0.0)]
    assert L.held_out_predictions(docs.limit(0)).count() == 0


def test_totals_against_brute_force(spark):
    """Every prediction from plain dictionaries: known words, backed-off n-grams of the others, the prior, all words of a text."""
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect() if r.text]
    taught, asked = [d for d in docs if d[0] % 3], docs
    split = lambda t: re.findall("[a-z\u0080-\U0010ffff]+", t.lower())
    langs = sorted({d[2] for d in taught if d[2]})
    words = {g: Counter(w for _, t, lang in taught if lang == g for w in split(t)) for g in langs}

    def bucket(gram):
        h = len(gram)
        for c in gram:
            h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) % 2**64
        return int(mix(np.array([h], np.uint64))[0]) >> 48

    def grams(word, n):
        edged = f"_{word}_"
        return [bucket(edged[i : i + n]) for i in range(len(edged) - n + 1) if edged[i : i + n] != "_"]

    seen = {g: {n: Counter() for n in range(1, 5)} for g in langs}
    for g in langs:
        for w, times in words[g].items():
            for n in range(1, 5):
                for b in grams(w, n):
                    seen[g][n][b] += times
    known = set().union(*words.values())
    tokens = {g: sum(words[g].values()) for g in langs}
    sums = {g: {n: sum(seen[g][n].values()) for n in range(1, 5)} for g in langs}

    @cache
    def scores(word):
        if word in known:
            return [math.log((words[g][word] + 0.5) / (tokens[g] + 0.5 * len(known))) for g in langs]
        for n in range(4, 0, -1):
            found = [b for b in grams(word, n) if any(seen[g][n][b] for g in langs)]
            if found:
                return [sum(math.log((seen[g][n][b] + 0.5) / (sums[g][n] + 0.5 * 65536)) for b in found) / len(found) for g in langs]
        return [0.0] * len(langs)

    prior = [math.log((tokens[g] + 1) / (sum(tokens.values()) + len(langs))) for g in langs]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in L.predict(frame(asked), L.fit(frame(taught))).collect()}
    judged = 0
    for i, text, _ in asked:
        ws = split(text)
        if not ws:
            assert got[i].lang_pred == "und"
            continue
        each = [scores(w) for w in ws]
        totals = [sum(s[k] for s in each) + prior[k] for k in range(len(langs))]
        best, second = sorted(totals)[-1:-3:-1]
        if best - second > 1e-3 * abs(best):
            judged += 1
            assert got[i].lang_pred == langs[totals.index(best)], text[:80]
            part = min(len(ws), 20) / len(ws)
            odds = [part * (t - p) + p for t, p in zip(totals, prior)]
            share = 1 / sum(math.exp(o - odds[totals.index(best)]) for o in odds)
            assert abs(got[i].score - share) < 1e-3
    assert judged > 0.9 * len(asked)


def test_all_words_decide(spark):
    """Twenty words do not outweigh the rest: the prior of a language taught a million times more loses to 4,000 words."""
    model = L.Model(["a", "b"], np.sort(Words([b"x"], "letter").hash), np.array([[-1.01, -1.0]], np.float32), np.zeros((4, 1 << 16), bool), np.zeros((4, 1 << 16, 2), np.float32), np.log([0.999, 0.001]))
    rows = L.predict(spark.createDataFrame([(1, "x " * 10), (2, "x " * 4000)], "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.lang_pred for r in rows} == {1: "a", 2: "b"} and all(0 <= r.score <= 1 for r in rows)
