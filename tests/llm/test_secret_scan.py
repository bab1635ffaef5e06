"""Secrets: base spans against Python's expressions, the models against counts in Python, held-out accuracy, hostile texts."""

import base64
import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest

from habitus.llm import queries, secret_scan as S
from tests.conftest import SF_DIR

FORMS = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
LEAST = {"access": 18, "hex": 16}


def base(text):
    spans = []
    for k, f in FORMS.items():
        spans += [(m.start(), list(FORMS).index(k), m.end()) for m in re.finditer(f, text or "") if (len(m.group(1)) >= 12 if k == "assign" else len(m.group()) >= LEAST[k])]
    return [(list(FORMS)[k], a, b) for a, k, b in sorted(spans)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return S.fit(docs)


def found(spark, model, texts):
    df = spark.createDataFrame([(i, t, "b", 1) for i, t in enumerate(texts)], "doc_id long, text string, hits string, row int")
    return {r.doc_id: ([tuple(s) for s in r.base], [tuple(s) for s in r.added]) for r in S.find(df, model).collect()}


def test_base_against_python(spark, model):
    rng = random.Random(8)
    bits = ["password", "PassWd", "token", "secret", "api_key", "APIKEY", "=", ":", " ", "\"", "'", "AKIA", "AKIA12", "ABCDEFGHIJKLMN", "0123456789abcdef", "dead", "beef", "x" * 12,
            "a.b/c+d-e_f=", "é", "😀", "\n", "\t", "", "-", "K"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 16))) for _ in range(3000)]
    texts += [None, "", "secret:token: abcdefghijklmnop", "AKIAKIA0123456789", "AKIAAKIA0123456789", "token = token = abcdefghijkl", "api__key=abcdefghijklmnop"]
    got = found(spark, model, texts)
    for i, t in enumerate(texts):
        assert got[i][0] == base(t), repr(t)
        assert all(k == "random" and b - a >= S.LONG for k, a, b in got[i][1]) and not any(a < y and x < b for _, a, b in got[i][1] for _, x, y in got[i][0])


def test_query_against_python(spark, docs):
    rows = {r.doc_id: r for r in queries.QUERIES["op11_secret_scan"](spark, SF_DIR).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(rows) == set(texts)
    for i, text in texts.items():
        want = base(text)
        assert [rows[i][f"n_{k}"] for k in FORMS] == [sum(s[0] == k for s in want) for k in FORMS]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert rows[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(joined.split(",")) <= set(rows[i].spans.split(",")) | {""}


def test_models_against_python(spark):
    texts = ["token = abc123abc123 some_ordinary_name x", "plain_words-only otherwise 12345678901234", "aB3" * 5, None, "plain_words-only"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {(r.value, r.label) for r in S.samples(df, 0).collect()}
    assert got == {("abc123abc123", "random"), ("some_ordinary_name", "ordinary"), ("plain_words-only", "ordinary"), ("12345678901234", "ordinary")}
    count = Counter()
    for value, label in got:
        count.update((label, a, b) for a, b in zip([S.START, *map(S.ALPHABET.index, value)], map(S.ALPHABET.index, value)))
    table = S.ratios(S.transitions(S.samples(df, 0)))
    size = len(S.ALPHABET)
    def chance(label, a, b):
        share = [sum(count[label, x, y] for x in range(size + 1)) + S.SMOOTH for y in range(size)]
        return (count[label, a, b] + S.PRIOR * share[b] / sum(share)) / (sum(count[label, a, y] for y in range(size)) + S.PRIOR)

    for a in (0, 5, 30, 55, size - 1, size):
        for b in range(size):
            assert abs(table[a * size + b] - S.MICRO * (math.log(chance("random", a, b)) - math.log(chance("ordinary", a, b)))) <= 1
    value = "some_abc123-name"
    row = spark.createDataFrame([(value,)], "v string").select(S.likelihood_ratio(S.F.col("v"), table)).first()[0]
    assert row == sum(table[a * size + b] for a, b in zip([S.START, *map(S.ALPHABET.index, value)], map(S.ALPHABET.index, value)))


def test_held_out_accuracy(spark, model):
    rng = random.Random(11)
    make = lambda n: base64.b64encode(rng.randbytes(n)).decode().rstrip("=")
    secret = [make(rng.randrange(18, 40)) for _ in range(300)]
    words = "the customer account transaction history backup request handler service".split()
    plain = [rng.choice("_-/").join(rng.choice(words) for _ in range(4)) + rng.choice(["", "_2024", "_v2"]) for _ in range(300)]
    got = found(spark, model, [f"see {x} here" for x in secret + plain])
    hit = [bool(got[i][1]) for i in range(600)]
    assert sum(hit[:300]) >= 290 and sum(hit[300:]) <= 6
    one = found(spark, model, [f"é😀 ({secret[0]})"])[0]
    assert one == (base(secret[0]), [("random", 4, 4 + len(secret[0]))])


def test_awkward_rows(spark, model):
    text = "token = 0123456789abcdef0123"
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None), (3, "")], "doc_id long, text string")
    rows = sorted((tuple(r) for r in S.report(S.find(df, model)).collect()), key=str)
    spans = "assign:0:28,hex:8:28"
    full, empty = (1, 0, 1, hashlib.sha256(spans.encode()).hexdigest(), spans), (0, 0, 0, hashlib.sha256(b"").hexdigest(), "")
    assert rows == sorted([(1, *full), (1, *full), (None, *full), (2, *empty), (3, *empty)], key=str)
    none = df.filter("doc_id = 9")
    assert S.report(S.find(none, S.fit(none))).count() == 0
    assert len(S.ratios(S.transitions(S.samples(none, 0)))) == (S.START + 1) * S.START


def test_time_follows_the_length(spark, model):
    def seconds(n):
        text = "".join(f"token={i:016x} k{i}Zq8Xw2Lp9Vb4Nm7Rt1Ys{i} " for i in range(n)) + "a" * n * 20 + " token" + " " * n * 20
        start = time.time()
        spans = found(spark, model, [text])[0]
        assert len(spans[0]) >= 2 * n and len(spans[1]) >= n * 0.9
        return time.time() - start

    seconds(500)
    small, large = seconds(5000), seconds(20000)
    assert large < 4 * 1.7 * small + 2
