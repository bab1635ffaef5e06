"""Token store: ids equal the library's, positions and checksums come from the files, the files are laid out as asked."""

import functools
import glob
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from habitus.llm import queries, token_store as T
from tests.conftest import SF_DIR


@functools.cache
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(T.TOKENIZER))


def library(texts):
    t = tokenizer()
    return [e.ids + [2] for e in t.encode_batch(texts, add_special_tokens=False)]


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id")
    got = queries.QUERIES["op8_token_parquet"](spark, SF_DIR).toPandas().sort_values("doc_id")
    start, want = 0, []
    for doc_id, ids in zip(docs["doc_id"], library(docs["text"].fillna("").tolist())):
        want.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert [tuple(r) for r in got[["doc_id", "start", "n_tokens", "ids_crc32"]].itertuples(index=False)] == want


def test_layout_and_selective_reads(spark, tmp_path):
    df = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for dictionary in (True, False):
        path = f"{tmp_path}/{dictionary}"
        T.write(df, path, dictionary=dictionary, row_group=256 << 10, page=4096)
        meta = [pq.ParquetFile(f).metadata for f in glob.glob(f"{path}/*.parquet")]
        assert max(m.num_row_groups for m in meta) > 1 or len(meta) > 1
        chunk = meta[0].row_group(0).column(2)
        assert chunk.has_offset_index and meta[0].row_group(0).column(0).has_column_index
        encodings = set(chunk.encodings)
        assert ("RLE_DICTIONARY" in encodings) if dictionary else ("DELTA_BINARY_PACKED" in encodings)
        plan = T.positions(spark, path)._jdf.queryExecution().executedPlan().toString()
        assert "ids" not in plan.split("ReadSchema")[1].split(">")[0]
        got = {r.doc_id: r.ids for r in T.read_tokens(spark, path, 10, 12).collect()}
        texts = {r.doc_id: r.text for r in df.filter("doc_id between 10 and 12").collect()}
        assert got == {k: library([v])[0] for k, v in texts.items()}


def test_awkward_rows(spark, tmp_path):
    special = "a<|endoftext|>b"
    rows = [(2, "", 0), (1, None, 0), (None, "x", 0), (3, special, 0), (3, special, 0), (9, "y " * 30000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    T.write(df, f"{tmp_path}/t")
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in T.report(spark, f"{tmp_path}/t").collect())
    lengths = [len(x) for x in library(["x", "", "", special, special, "y " * 30000])]
    assert [g[2] for g in got] == lengths and [g[1] for g in got] == [None, 1, 2, 3, 3, 9]
    assert [g[0] for g in got] == [sum(lengths[:i]) for i in range(6)]
    T.write(df.limit(0), f"{tmp_path}/none")
    assert T.report(spark, f"{tmp_path}/none").count() == 0


def test_ids_equal_the_library_around_every_codepoint():
    cache = T.library_cache(public_tokenizers.path(T.TOKENIZER))
    for start in (*range(0, 0x34000, 0x8000), 0xE0000, 0x108000):  # planes without assigned code points are left out
        text = "".join(f"a{chr(c)} {chr(c)}b 1" for c in range(start, start + 0x8000) if not 0xD800 <= c < 0xE000)
        ids, _ = T.encode_texts([text.encode()], cache)
        assert ids.tolist() == library([text])[0][:-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab é\u0301ß's\t\n1字-", max_size=30), max_size=6))
def test_ids_equal_the_library(texts):
    ids, n = T.encode_texts([t.encode() for t in texts], T.library_cache(public_tokenizers.path(T.TOKENIZER)))
    assert [r.tolist() for r in np.split(ids, np.cumsum(n))[:-1]] == [x[:-1] for x in library(texts)]


def test_added_tokens_as_in_the_untouched_library(spark, tmp_path):
    untouched = Tokenizer.from_file(public_tokenizers.path(T.TOKENIZER))
    mark = "<|endoftext|>"
    texts = [f"a{mark}b", mark, mark * 3, f"one  {mark}  two {mark}\n", f"<|endoftext{mark}|>", f"é{mark}字", "<|endoftext|", "", None, "plain text"]
    T.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), f"{tmp_path}/t")
    want = [untouched.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    got = {r.doc_id: r.ids for r in T.read_tokens(spark, f"{tmp_path}/t", 0, len(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want and sum(x.count(50256) for x in want) == 9
    start = {r.doc_id: r.start for r in T.report(spark, f"{tmp_path}/t").collect()}
    assert [start[i] for i in range(len(texts))] == [sum(map(len, want[:i])) for i in range(len(texts))]
