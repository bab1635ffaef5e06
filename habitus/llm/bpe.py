"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Every codepoint gets a class from a table; with a glance at its neighbours the class becomes a symbol; an automaton of
eight states reads the symbols. A symbol is a function from state to state, and composing such functions is associative,
so the state before every codepoint comes from a blocked scan over arrays, and no regular expression runs. The slices
between boundaries go through pair merging once; a bounded cache keeps their ids. Byte offsets are kept for decoding.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Callable
from itertools import chain, islice, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from habitus.llm.text import lists, per_batch, raw

RANKS = "byte_bpe_50k.tiktoken"
CACHE = 3 << 18  # slices whose ids a worker remembers
LONG_SLICE = 64  # bytes; longer slices are merged anew each time and never kept
BLOCK = 256  # codepoints that one lane of the scan reads

# Codepoint classes.
LETTER, NUMBER, WHITE, OTHER = range(4)
# Symbols: a class, or a class in its place. BLANK is a space that the next slice takes in, LONE another white space before
# a visible character, RUN white space before white space or the end; TWO and THREE start a contraction of that length.
S_LETTER, S_NUMBER, S_OTHER, S_TWO, S_THREE, S_BLANK, S_LONE, S_RUN, S_END = range(9)
FRESH = 9  # added to a symbol that begins a text: whatever came before is forgotten
# States: nothing open; inside letters, numbers, others or white space; after a BLANK; 1 or 2 contraction letters to come.
NOTHING, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, AFTER_BLANK, ONE_MORE, TWO_MORE = range(8)


@functools.cache
def classes() -> np.ndarray:
    """The class of every codepoint; letters and numbers as the tokenizer library's edition of Unicode has them."""
    import tiktoken

    table = np.full(0x110001, OTHER, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([i]): i for i in range(256)}
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        library = tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = library.decode(library.encode_ordinary(every)).encode("utf-32-le")
        table[np.frombuffer(found, np.uint32)] = kind
    white = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table[white] = WHITE  # the White_Space property
    return table


@functools.cache
def transitions() -> tuple[np.ndarray, np.ndarray]:
    """[symbol, state] -> next state, and whether a slice starts at the symbol."""
    step, starts = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for state in range(8):
        def go(symbol: int, to: int, start: bool = True, state: int = state) -> None:
            step[symbol, state], starts[symbol, state] = to, start

        blank = state == AFTER_BLANK
        go(S_LETTER, IN_LETTERS, not (blank or state == IN_LETTERS))
        if state in (ONE_MORE, TWO_MORE):
            go(S_LETTER, NOTHING if state == ONE_MORE else ONE_MORE, False)
        go(S_NUMBER, IN_NUMBERS, not (blank or state == IN_NUMBERS))
        go(S_OTHER, IN_OTHERS, not (blank or state == IN_OTHERS))
        for symbol, to in ((S_TWO, ONE_MORE), (S_THREE, TWO_MORE)):
            inside = blank or state == IN_OTHERS
            go(symbol, IN_OTHERS if inside else to, not inside)
        go(S_BLANK, AFTER_BLANK)
        go(S_LONE, NOTHING)
        go(S_RUN, IN_WHITE, state != IN_WHITE)
        go(S_END, NOTHING)
    fresh = np.repeat(step[:, :1], 8, axis=1)
    return np.concatenate([step, fresh]), np.concatenate([starts, np.ones((9, 8), bool)])


@functools.cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that sequences of symbols make of the states, numbered: the composition table (first, then second),
    the number of each symbol's function, and where each function takes state 0. Few differ, as most forget the state."""
    step, _ = transitions()
    functions: dict[bytes, int] = {bytes(range(8)): 0}
    order = [bytes(range(8))]
    for f in order:
        for g in step:
            if (h := bytes(g[list(f)])) not in functions:
                functions[h] = len(order)
                order.append(h)
    table = np.frombuffer(b"".join(order), np.uint8).reshape(-1, 8)
    compose = np.array([[functions[bytes(g[f])] for g in table] for f in table], np.uint16)
    return compose, np.array([functions[bytes(g)] for g in step], np.uint16), table[:, 0].copy()


def scan(symbols: np.ndarray) -> np.ndarray:
    """Whether a slice starts at each symbol, from state 0, by composing transition functions block by block."""
    n = len(symbols)
    lanes = -(-n // BLOCK)
    grid = np.full(lanes * BLOCK, S_END, np.intp)
    grid[:n] = symbols
    grid = grid.reshape(lanes, BLOCK).T.copy()
    compose, of_symbol, image = monoid()
    size = len(compose)
    flat = compose.reshape(-1).astype(np.intp) * size  # a function's number times size, so that an addition finds the next
    single = of_symbol.astype(np.intp)
    whole = single[grid[0]] * size  # of each lane: the function from its first to its last state
    for row in grid[1:]:
        whole = flat.take(whole + single.take(row))
    prefix, width = whole, 1
    while width < lanes:  # inclusive scan over the lanes by doubling
        prefix, width = np.concatenate([prefix[:width], flat.take(prefix[:-width] + prefix[width:] // size)]), width * 2
    state = np.zeros(lanes, np.intp)
    state[1:] = image[prefix[:-1] // size]
    step, starts = (x.reshape(-1) for x in transitions())
    step, opens = step.astype(np.intp), np.empty((BLOCK, lanes), bool)
    for k, row in enumerate(grid):
        at = (row << 3) + state
        opens[k] = starts.take(at)
        state = step.take(at)
    return opens.T.reshape(-1)[:n]


def slices(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts in one buffer, the byte range borders of their slices, and the first slice of each text.

    Slice i is data[border[i]:border[i + 1]]; a text's slices cover it without gaps.
    """
    data = b"".join(texts)
    size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    buf = np.frombuffer(data, np.uint8)
    lead = np.flatnonzero(buf.view(np.int8) > -65)  # the first byte of each codepoint; the others are 0x80 to 0xBF
    points = np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    text_start = np.concatenate([[0], np.cumsum(size)])
    ends = np.searchsorted(lead, text_start[1:])  # codepoints up to the end of each text
    at = np.concatenate([points, np.zeros(3, np.uint32)])
    kind = np.concatenate([classes()[points], np.full(1, WHITE, np.uint8)])
    after = kind[1:].copy()
    after[ends[ends > 0] - 1] = WHITE  # a text ends as white space would, with nothing visible behind
    kind = kind[:-1]
    symbols = np.array([S_LETTER, S_NUMBER, S_RUN, S_OTHER], np.uint8)[kind]
    last = np.flatnonzero((kind == WHITE) & (after != WHITE))
    symbols[last] = np.where(points[last] == 0x20, S_BLANK, S_LONE)
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        room = np.repeat(ends, np.diff(ends, prepend=0))[quote] - quote
        one, two = at[quote + 1], at[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"]) & (room > 1)
        pair = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b)) & (room > 2)
        symbols[quote[pair]], symbols[quote[short]] = S_THREE, S_TWO
    symbols[np.concatenate([[0], ends[:-1]])[size > 0]] += FRESH
    border = lead[scan(symbols)]
    return data, np.concatenate([border, [len(data)]]), np.searchsorted(border, text_start)


@functools.cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the neighbouring pair of lowest rank, the leftmost first, until none has a rank."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) > LONG_SLICE:
        return merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, 0
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap over linked parts, for slices of any length."""
    n = len(piece)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and (j := end[i]) < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, j, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        r, i, j, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != j or not alive[j] or end[j] != stop:
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
        offer(before[i])
        offer(i)
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


def merge_all(pieces: list[bytes], ranks: dict[bytes, int]) -> tuple[list[int], list, list]:
    got = [merge(p, ranks) for p in pieces]
    counts = np.fromiter(map(len, got), np.int64, len(got))
    return list(range(len(pieces))), [np.fromiter(chain.from_iterable(got), np.int32, int(counts.sum()))], [counts]


class SliceCache:
    """Ids of slices in one growing array; encode turns missing slices into ids.

    Once it is full it keeps its oldest part, as frequent slices come early.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[list[int], list, list]], most: int = CACHE):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids, self.start, self.used = np.empty(1 << 16, np.int32), np.zeros(1, np.int64), 0

    def shrink(self) -> None:
        keep = self.most // 3
        if self.start[min(keep, len(self.start) - 1)] > 4 * self.most:  # long slices fill it
            return self.clear()
        self.place = dict(islice(self.place.items(), keep))  # in order of arrival
        self.start = self.start[: len(self.place) + 1].copy()
        self.used = int(self.start[-1])

    def add(self, pieces: list[bytes]) -> np.ndarray:
        """Store new slices; their places in the cache."""
        order, ids, counts = self.encode(pieces)  # ids and their counts may come in another order
        size = np.concatenate(counts)
        total = self.used + int(size.sum())
        if total > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(total + len(self.ids), np.int32)])
        self.ids[self.used : total] = np.concatenate(ids)
        at = len(self.start) - 1
        self.place.update(zip(map(pieces.__getitem__, order), range(at, at + len(pieces))))
        self.start = np.concatenate([self.start, self.used + np.cumsum(size)])
        self.used = total
        out = np.empty(len(pieces), np.int64)
        out[order] = np.arange(at, at + len(pieces))
        return out

    def __call__(self, data: bytes, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all slices in order, and the number of ids of each slice."""
        ends = pa.py_buffer(border.astype(np.int64))
        coded = pa.Array.from_buffers(pa.large_binary(), len(border) - 1, [None, ends, pa.py_buffer(data)]).dictionary_encode()
        cut = np.frombuffer(coded.dictionary.buffers()[1], np.int64)[: len(coded.dictionary) + 1].tolist()
        once = coded.dictionary.buffers()[2].to_pybytes() if cut[-1] else b""
        pieces = [once[x:y] for x, y in zip(cut, cut[1:])]  # each slice of the batch once
        if len(self.place) > self.most or self.used > 8 * self.most:
            self.shrink()
        row = np.fromiter(map(self.place.get, pieces, repeat(-1)), np.int64, len(pieces))
        if len(new := np.flatnonzero(row < 0)):
            row[new] = self.add([pieces[i] for i in new.tolist()])
        row = row[coded.indices.to_numpy()]
        size = (self.start[1:] - self.start[:-1])[row]
        return gather(self.ids, self.start[row], size), size


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start[i]:start[i] + size[i]] for every i, one after the other."""
    off = np.cumsum(size) - size
    return values[np.arange(int(size.sum())) + np.repeat(start - off, size)]


@functools.cache
def rank_cache(path: str) -> SliceCache:
    ranks = load_ranks(path)
    return SliceCache(lambda pieces: merge_all(pieces, ranks))


@functools.cache
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens in one array, and the start and length of each id."""
    by_id = {i: b for b, i in load_ranks(path).items()}
    parts = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size


def encode_texts(texts: list[bytes], cache: SliceCache) -> tuple[np.ndarray, np.ndarray]:
    """All ids of all texts, and the number of ids of each text."""
    data, border, first = slices(texts)
    ids, size = cache(data, border)
    total = np.concatenate([[0], np.cumsum(size)])
    return ids, np.diff(total[first])


def encode(df: DataFrame, column: str = "text", ranks: str = RANKS, keep: tuple[str, ...] = ("doc_id",), verify: str | None = None) -> DataFrame:
    """Add ids and offsets (the byte where each token ends) to the columns in keep; and, if verify names a column, whether
    decoding the ids gives the text back.

    Null and empty texts give empty lists; repeated rows give equal lists; other columns are left out, so none can clash.
    """
    path = public_tokenizers.path(ranks)
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batch: pa.RecordBatch):
        texts = raw(batch.column(len(keep)))
        ids, n = encode_texts(texts, rank_cache(path))
        size = vocabulary(path)[2][ids]
        stop = np.cumsum(size)
        base = np.concatenate([[0], stop])[np.cumsum(n) - n]
        offsets = (stop - np.repeat(base, n)).astype(np.int64)
        columns, names = [*batch.columns[: len(keep)], lists(ids, n), lists(offsets, n)], [*keep, "ids", "offsets"]
        if verify:
            data, size = decode_ids(ids, n, path)
            stop = np.cumsum(size)
            same = [data[a:b].tobytes() == t for a, b, t in zip((stop - size).tolist(), stop.tolist(), texts)]
            columns, names = [*columns, pa.array(same, pa.bool_())], [*names, verify]
        yield pa.record_batch(columns, names)

    return per_batch(df.select(*keep, column), run, f"{kinds}, ids array<int>, offsets array<bigint>" + (f", `{verify}` boolean" if verify else ""))


def decode_ids(ids: np.ndarray, counts: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids in order, and the number of bytes of each row."""
    table, start, size = vocabulary(path)
    n = size[ids]
    total = np.concatenate([[0], np.cumsum(n)])
    row = np.concatenate([[0], np.cumsum(counts)])
    return gather(table, start[ids], n), np.diff(total[row])


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of an Arrow list column and the length of each row."""
    off = np.asarray(column.offsets)
    return column.values.slice(off[0], off[-1] - off[0]).to_numpy(zero_copy_only=False), np.diff(off)


def decode(df: DataFrame, column: str = "ids", ranks: str = RANKS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The decoded bytes of every list of ids, as column decoded beside those in keep. Null counts as an empty list."""
    path = public_tokenizers.path(ranks)
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batch: pa.RecordBatch):
        ids, n = flat(batch.column(len(keep)))
        data, size = decode_ids(ids, n, path)
        stop = np.cumsum(size)
        data = data.tobytes()
        out = pa.array([data[a:b] for a, b in zip((stop - size).tolist(), stop.tolist())], pa.binary())
        yield pa.record_batch([*batch.columns[: len(keep)], out], [*keep, "decoded"])

    filled = df.select(*keep, F.coalesce(column, F.array().cast("array<int>")).alias(column))
    return per_batch(filled, run, f"{kinds}, decoded binary")


def token_slice(df: DataFrame, start: int, stop: int) -> DataFrame:
    """Keep tokens start to stop of every row and the byte range of the text that they stand for."""
    begin = F.when(F.lit(start) > 0, F.coalesce(F.try_element_at("offsets", F.lit(start)), F.lit(0))).otherwise(F.lit(0))
    return df.withColumns({
        "byte_start": begin.cast("long"),
        "ids": F.slice("ids", start + 1, max(0, stop - start)),
        "byte_end": F.coalesce(F.array_max(F.slice("offsets", start + 1, max(0, stop - start))), begin).cast("long"),
    })


@functools.cache
def decimals(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [b"%d " % i for i in range(n)]
    size = np.fromiter(map(len, parts), np.int64, n)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size


def digest(df: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, n_tokens and the hashes of the ids and of the bytes that they decode to, from an encoded table."""
    path = public_tokenizers.path(ranks)

    def run(batch: pa.RecordBatch):
        ids, n = flat(batch.column(1))
        data, size = decode_ids(ids, n, path)
        table, start, width = decimals(len(vocabulary(path)[1]))
        text = gather(table, start[ids], width[ids]).data
        text_stop = np.concatenate([[0], np.cumsum(width[ids])])[np.cumsum(n)]
        text_start = np.concatenate([[0], text_stop[:-1]])
        stop = np.cumsum(size)
        ids_sha = [hashlib.sha256(text[a : max(a, b - 1)]).hexdigest() for a, b in zip(text_start.tolist(), text_stop.tolist())]
        out_sha = [hashlib.sha256(data.data[a:b]).hexdigest() for a, b in zip((stop - size).tolist(), stop.tolist())]
        yield pa.record_batch(
            [batch.column(0), pa.array(n.astype(np.int64)), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return per_batch(df.select("doc_id", "ids"), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
