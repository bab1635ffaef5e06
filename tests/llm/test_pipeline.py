"""The pipeline stage by stage against brute force, and on awkward rows."""

import corpus_pipeline as C
import pytest
import tiktoken
import public_tokenizers
from pyspark.sql import functions as F

from habitus.llm import bpe
from tests.conftest import SF_DIR
from tests.llm import test_decontaminate, test_group_join, test_pii

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def redact(text):
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in test_pii.base(text)):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def brute(docs, items):
    docs = [(i, t) for i, t in docs if t and any(c.isalpha() for c in t)]
    groups = {i: c for i, _, c in test_group_join.brute(docs)}
    docs = [(i, t) for i, t in docs if groups[i] == i or not test_group_join.shingles(t)]
    hit = {r[0] for r in test_decontaminate.brute(docs, items) if r[5]}
    return {i: redact(t) for i, t in docs if i not in hit}


def test_run_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(bpe.RANKS)), special_tokens={})
    got = {r.doc_id: r for r in C.run(spark, SF_DIR).collect()}
    want = brute(docs, items)
    assert set(got) == set(want) and 0 < len(want) < len(docs)
    for i, text in want.items():
        assert got[i].ids == library.encode_ordinary(text) and got[i].n_tokens == len(got[i].ids) and got[i].round_trip


@pytest.fixture(scope="module")
def awkward(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "a", 9), (1, text, "en", "a", 9), (None, text + " x", None, None, None), (2, None, "en", None, 0), (3, "", None, "b", 0), (4, "12 34", "en", "b", 5),
            (5, "mail a@b.co now", "de", "b", 15), (6, "long " * 30_000, "en", "c", 150_000), (7, "one", "en", "c", 3), (7, "two", "en", "c", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select(*COLUMNS, F.lit(1).alias("row"), F.lit("k").alias("row_key"))


def test_awkward_rows_pass_every_stage(spark, awkward):
    docs = awkward
    left = {}
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == awkward.columns
        left[name] = sorted((r.doc_id or 0, (r.text or "")[:20]) for r in docs.collect())
    assert [i for i, _ in left["language"]] == [0, 1, 1, 5, 6, 7, 7]
    assert [i for i, _ in left["near copies"]] == [1, 5, 6, 7, 7] == [i for i, _ in left["benchmark"]]
    assert (5, "mail [EMAIL] now") in left["personal data"]
    assert C.tokenize(spark, docs, SF_DIR).filter("round_trip").count() == 5


def test_empty_table_passes_every_stage(spark, awkward):
    for _, stage in C.STAGES:
        assert stage(spark, awkward.limit(0), SF_DIR).count() == 0
    empty_text = C.drop_near_copies(spark, awkward.filter("doc_id IN (2, 3)").unionAll(awkward.filter("doc_id = 3")), SF_DIR)
    assert empty_text.count() == 3


def near_copies_left(docs, size=5, percent=80):
    """Ids that stay: the least of each group that links of Jaccard similarity over word shingles hold together."""
    words = {i: t.lower().split() for i, t in docs}
    sets = {i: {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} for i, w in words.items()}
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = {k: low if x == high else x for k, x in label.items()}
    return sorted(i for i in label if label[i] == i)


def test_near_copies_of_five_words_and_four_fifths_go(spark):
    whole = [f"word{i}" for i in range(100)]
    docs = [(1, " ".join(whole)), (2, " ".join(whole[:82])), (3, " ".join(whole[:80]))]  # 78/96 = 0.81; 76/96 = 0.79, but 76/78 of the second
    docs += [(4, " ".join(f"other{i}" for i in range(100))), (5, " ".join(f"other{i}" for i in range(80)))]  # 76/96 = 0.79
    long = [f"l{i}" for i in range(1000)]
    for k, edits in ((7, 20), (8, 21), (9, 22)):
        docs.append((k, " ".join(f"e{k}x{i}" if i % 45 == 7 and i // 45 < edits else w for i, w in enumerate(long))))
    docs.append((6, " ".join(long)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = near_copies_left(docs)
    assert sorted(r.doc_id for r in C.drop_near_copies(spark, df, SF_DIR).collect()) == want
    assert 2 not in want and {1, 4, 5, 6} <= set(want)
