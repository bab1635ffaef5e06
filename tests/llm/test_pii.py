"""Personal data: base spans against Python's expressions, contexts that reveal more, redaction, hostile texts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from habitus.llm import pii as P, queries
from tests.conftest import SF_DIR

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fine(kind, s):
    d = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
    return 9 <= len(d) <= 15 if kind == "phone" else True


def base(text):
    return [(k, m.start(), m.end()) for k, f in FORMS.items() for m in re.finditer(f, text or "") if fine(k, m.group())]


def found(spark, texts):
    df = spark.createDataFrame([(i, t, "b") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    return {r.doc_id: ([tuple(s) for s in r.base], [tuple(s) for s in r.added]) for r in P.find(df).collect()}


def test_base_against_python(spark):
    rng = random.Random(8)
    bits = ["a@b.c", "x.y_z@q-r.co.uk", "@", "..", ".", "-", " ", "+", "1", "23", "4111111111111111", "4111 1111-1111 1111", "+1 (632) 555-4827", "+44.20.7946.0958",
            "10.0.0.1", "300.1.1.1", "1.2.3.4.5.6.7.8", "é", "😀", "\n", "_", "%", "(", ")", "a", "", "000000001.2.3.4", "\t"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    texts += [None, "", "a@b.c_d@e.f", "a@b..c", "a@b.c.", "a@b.c.@d.e", "1-2--3", "+1--------9999999999", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5"]
    got = found(spark, texts)
    for i, t in enumerate(texts):
        assert got[i][0] == base(t), repr(t)


def test_query_against_python(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in queries.QUERIES["op5_pii"](spark, SF_DIR).collect()}
    assert set(rows) == set(docs)
    for i, text in docs.items():
        want = base(text)
        assert [rows[i][f"n_{k}"] for k in FORMS] == [sum(s[0] == k for s in want) for k in FORMS]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert rows[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(joined.split(",")) <= set(rows[i].spans.split(","))


def test_patterns_reveal_unseen_identifiers(spark):
    texts = [f"Please call phone: +1 (632) 555-48{i:02d} today" for i in range(12)] + [f"mail: user{i}@example.org now" for i in range(9)]
    texts += ["my phone: 632-555-9911.", "mail: someone[at]example7 ok", "room 2024-0007-11 is free", "the phone: number"]
    texts += [f"the 20{i:02d}-11-05 and the 18{i:02d}-07-09" for i in range(10)]
    got = found(spark, texts)
    at = texts[21].index("632-555-9911")
    assert got[21][1] == [("phone", at, at + 12)]
    assert got[22][1] == [("email", 6, 6 + len("someone[at]example7"))]
    assert all(not added for i, (_, added) in got.items() if i not in (21, 22))


def test_scores_go_on_from_found_identifiers(spark):
    edges = [("phone", f"s{i}", "phone") for i in range(9)] + [("phone", "u1", None), ("phone", "u2", None), ("phone", "u3", None), ("phone", "u4", None)]
    edges += [("tel", f"u{i}", None) for i in range(1, 5)] + [("tel", "u9", None)] + [("of", "u1", None), ("of", "z1", None), ("of", "z2", None)]
    patterns, values = P.trusted_patterns(spark.createDataFrame(edges, "pattern string, value string, kind string"), rounds=3)
    assert {r.pattern for r in patterns.collect()} == {"phone"} and {r.value for r in values.collect()} >= {"u1", "u4", "s0"}
    more = [("phone", f"s{i}", "phone") for i in range(40)] + edges[9:]
    patterns, values = P.trusted_patterns(spark.createDataFrame(more, "pattern string, value string, kind string"), rounds=3)
    assert {r.pattern for r in patterns.collect()} == {"phone", "tel"} and "u9" in {r.value for r in values.collect()}


def test_hostile_texts(spark):
    texts = ["a" * 300_000, "1" * 100_000, "1 " * 60_000, "a@b" + ".c" * 50_000, "a." * 100_000, "+" * 50_000, "1." * 80_000, "@" * 90_000, "+1" + " 2" * 40_000, " " * 100_000 + "1"]
    got = found(spark, texts)
    assert got[3][0] == [("email", 0, 100_003)] and all(not got[i][0] for i in (0, 1, 2, 4, 5, 7, 9))


def test_redaction(spark):
    text = "é mail a@b.co or +1 (632) 555-4827, 4111 1111 1111 1111!"
    spans = [("email", 7, 13), ("phone", 17, 34), ("card", 36, 55), ("card", 40, 50)]
    df = spark.createDataFrame([(text, spans), ("x", []), (None, [])], "text string, spans array<struct<kind:string,start:int,end:int>>")
    got = [r[0] for r in df.select(P.redacted(F.col("text"), F.col("spans"))).collect()]
    assert got == ["é mail [EMAIL] or [PHONE], [CARD]!", "x", None]


def test_rows(spark):
    df = spark.createDataFrame([(None, "a@b.c"), (1, None), (2, "a@b.c"), (2, "a@b.c")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_email) for r in P.report(P.find(df)).collect()) == [(0, 1), (1, 0), (2, 1), (2, 1)]
    assert P.report(P.find(df.limit(0))).count() == 0


def test_patterns_reveal_identifiers_written_with_blanks(spark):
    texts = [f"Please call phone: +1 (632) 555-48{i:02d} today" for i in range(40)] + [f"the card: 4111 1111 1111 1111, {'x' * i}" for i in range(3)]
    texts += [f"card: {n}" for n in range(4 * 10 ** 15, 4 * 10 ** 15 + 300) if fine("card", str(n))]
    cases = [("my phone: 632 555 9911 now", "632 555 9911", "phone"), ("phone: (632) 555-4827.", "(632) 555-4827", "phone"), ("phone: (02)555 4827", "(02)555 4827", "phone"),
             ("phone: 632.555.9912, 12 of us", "632.555.9912", "phone"), ("phone: 632-555-9913. 12 people", "632-555-9913", "phone"),
             ("phone: (632 555 9914) é", "632 555 9914", "phone"), ("é phone: 632 - 555 - 9915 2nd floor", "632 - 555 - 9915", "phone"),
             ("card: 4111 1111 1111 1112 x", "4111 1111 1111 1112", "card"), ("phone: 632-555-9916 10.0.0.1", "632-555-9916", "phone"),
             ("phone: 632-555-9917 1a@b.co", "632-555-9917", "phone")]
    got = found(spark, texts + [c[0] for c in cases] + ["room 632 555 9911", "phone: 12", "of 3 4 5 6 7 8"])
    for i, (text, value, kind) in enumerate(cases, len(texts)):
        at = text.index(value)
        assert got[i][1] == [(kind, at, at + len(value))], text
    assert not any(got[len(texts) + len(cases) + i][1] for i in range(1, 3))


def test_hostile_runs_of_digits(spark):
    texts = ["1 " * 60_000 + "x", "1 " * 60_000 + "1x", "(1) " * 40_000 + "é1", "1-" * 80_000, "1.1 " * 40_000, "1" * 100_000 + " 2x", "1 (" * 50_000, "((1" * 50_000, "1 - " * 40_000]
    assert len(found(spark, texts)) == len(texts)


def test_time_grows_with_the_text(spark):
    """A text that is all matches: 4 MB take well under four times as long as 1 MB do, and all of its spans are found."""
    import time

    taken = {}
    for n in (2_000, 50_000, 200_000):
        text = "".join(f"user{i:06d}@ab.org x{i:06d}7 " for i in range(n))
        start = time.time()
        row = P.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.size("base"), F.element_at("base", -1)).first()
        taken[n] = time.time() - start
        assert row[0] == n and tuple(row[1]) == ("email", (n - 1) * 27, (n - 1) * 27 + 17)
    assert taken[200_000] < 8 * taken[50_000]
