"""Prefix trie: against a trie built in Python, hot conversations over many parts, awkward rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pyarrow as pa

from habitus.llm import prefix_trie as T, queries
from tests.conftest import SF_DIR

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((t is not None, t or 0, sha(f"{len(role.encode())}:{role}{text}"), role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        seq = tuple(turns.get(first, [])[:h] + v[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append((c, d == len(seq)))
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0) + sum(saved[x] for x in children[k])
        ends = ",".join(str(c) for c in sorted(c for c, end in members[k] if end))
        name = lambda x: min(members[x])[0]
        out.append((name(k), len(k), name(k[:-1]) if k else None, len(members[k]), len(children[k]), leaves[k], saved[k], sha(ends)))
    return sorted(out, key=str)


def built(spark, rows, schema=SCHEMA):
    return sorted((tuple(r) for r in T.trie(spark.createDataFrame(rows, schema)).collect()), key=str)


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in queries.QUERIES["op12_prefix_trie"](spark, SF_DIR).collect()), key=str)
    assert got == brute(rows)


def test_shared_openings_and_a_hot_conversation(spark, request):
    rng = random.Random(4)
    rows = [(c, t, "user" if t % 2 else "bot", rng.choice(["a", "bé", ""])) for c in range(-7, 160) for t in range(rng.randrange(1, 12))]
    rows += [(c, t, "user", "same") for c in range(500, 700) for t in range(3)]  # a third of all conversations are copies
    rows += [(800, t, "user", f"turn {t % 3}") for t in range(1500)]  # one conversation holds most turns: it is dealt to many parts
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with parts that are too large to merge
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    assert T.turns_in_order(df).filter("conv = 800").select("part").distinct().count() > 2
    assert built(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    long = "x" * 300000
    rows = [(0, None, None, None), (0, 1, "", ""), (0, 1, "u", "b"), (0, 1, "u", "a"), (0, 1, "u", "a"), (None, 1, "u", "t"), (1, 2, "u", long), (1, 1, None, "t"),
            (7, 1, "u", "lost"), (12, 1, "ab", "c"), (12, 2, "a", "bc"), (25, 0, "u", "t")]
    assert built(spark, rows) == brute(rows)
    extra = [(*r, 1, "x", 2) for r in rows]
    assert built(spark, extra, SCHEMA + ", part int, mark string, pos int") == brute(rows)
    assert built(spark, []) == [] and built(spark, [(None, 1, "u", "t")]) == []


def test_lists_are_hashed_across_batches():
    names = ["depth", "ka", "kb", "chunk", "ids"]
    batch = lambda *rows: pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])
    batches = [batch((1, 1, 1, 0, "1,2")), batch((1, 1, 1, 1, "5000"), (1, 1, 2, 0, "3")), batch((2, 0, 0, 0, "9"))]
    out = [tuple(r.values()) for b in T.hashed_lists(iter(batches)) for r in b.to_pylist()]
    assert out == [(1, 1, 1, sha("1,2,5000")), (1, 1, 2, sha("3")), (2, 0, 0, sha("9"))]
