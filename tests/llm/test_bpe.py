"""Byte-level BPE against the tiktoken library, on texts that are awkward for the automaton."""

import base64
import random

import numpy as np
import public_tokenizers
import regex
import tiktoken
from hypothesis import given, settings, strategies as st

from habitus.llm import bpe

PATH = public_tokenizers.path(bpe.RANKS)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
AWKWARD = ["", " ", "  ", "a  b", "don't", "''s", "!'s", " 's", "\t's", "'street", "'s't'll", "a\t\tb", "x \n\n y", "　a", "١٢ ab1",
           "I'LL i'll", "'", "'r", "'re", "'l", "é'll'", "end  ", "\x1c\x1d a", "字字 字", "a​b", "😀 😀😀", "word " * 50, "ab" * 500, "=" * 300]


def pieces(texts):
    data, border, first = bpe.slices([t.encode() for t in texts])
    got = [data[a:b].decode() for a, b in zip(border[:-1], border[1:])]
    return [got[a:b] for a, b in zip(first[:-1], first[1:])]


def test_slices_equal_the_pattern():
    rng = random.Random(3)
    some = ["".join(rng.choice("ab'stlvre  \t\n1!é ") for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts = AWKWARD + some
    assert pieces(texts) == [regex.findall(public_tokenizers.PATTERN, t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_ids_equal_the_library_and_round_trip(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    ids, n = bpe.encode_texts([t.encode() for t in texts], bpe.rank_cache(PATH))
    rows = np.split(ids, np.cumsum(n)[:-1]) if texts else []
    assert [r.tolist() for r in rows] == [LIBRARY.encode_ordinary(t) for t in texts]
    data, size = bpe.decode_ids(ids, n, PATH)
    assert data.tobytes() == "".join(texts).encode() and size.tolist() == [len(t.encode()) for t in texts]


def test_white_space_is_the_library_s():
    single = {bytes([i]): i for i in range(256)}
    only = tiktoken.Encoding("one", pat_str=r"\s", mergeable_ranks=single, special_tokens={})
    points = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    assert set(map(ord, only.decode(only.encode_ordinary(points)))) == set(np.flatnonzero(bpe.classes()[:0x110000] == bpe.WHITE).tolist())


def test_ids_equal_the_library_around_every_codepoint():
    for start in (*range(0, 0x34000, 0x8000), 0xE0000, 0x108000):  # planes without assigned code points are left out
        text = "".join(f"a{chr(c)} 1" for c in range(start, start + 0x8000) if not 0xD800 <= c < 0xE000)
        ids, _ = bpe.encode_texts([text.encode()], bpe.rank_cache(PATH))
        assert ids.tolist() == LIBRARY.encode_ordinary(text)


def test_rows_null_repeated_and_empty(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "don't  stop", "x"), (3, "don't  stop", "x"), (None, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    enc = bpe.encode(df)
    got = {(r.doc_id, tuple(r.ids)) for r in enc.collect()}
    assert got == {(i, tuple(LIBRARY.encode_ordinary(t or ""))) for i, t, _ in rows} and enc.count() == 5
    assert sorted(bytes(r.decoded) for r in bpe.decode(enc).collect()) == sorted((t or "").encode() for _, t, _ in rows)
    assert bpe.encode(df.limit(0)).count() == 0
    part = bpe.token_slice(enc.filter("doc_id = 3").limit(1), 1, 3).first()
    whole = LIBRARY.encode_ordinary("don't  stop")
    assert part.ids == whole[1:3] and b"don't  stop"[part.byte_start:part.byte_end] == LIBRARY.decode_bytes(whole[1:3])


def test_a_full_cache_keeps_giving_the_same_ids():
    rng = random.Random(6)
    cache = bpe.SliceCache(lambda pieces: bpe.merge_all(pieces, bpe.load_ranks(PATH)), most=60)
    for _ in range(40):
        text = " ".join(str(rng.randrange(200)) + rng.choice(["", "=" * 70, "abc"]) for _ in range(60))
        ids, _ = bpe.encode_texts([text.encode()], cache)
        assert ids.tolist() == LIBRARY.encode_ordinary(text)
    assert len(cache.place) < 400
