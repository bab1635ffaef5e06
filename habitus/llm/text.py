"""Words of a batch of texts as arrays, and the small helpers that every operator on texts shares."""

from __future__ import annotations

import ctypes
import hashlib
import os
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from habitus.session import scratch

U64 = np.uint64
BYTES_PER_BATCH = 2 << 20  # of text that a Python worker holds at once, unless one text is longer
SEGMENT = 1 << 20  # word bytes hashed at once

#: Bytes that are part of a word, by kind: anything but white space; letters and digits; letters (bytes over 127 count).
KEEP = {
    "space": np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)]),
    "alnum": np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 or b in range(97, 123) for b in range(256)]),
    "letter": np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)]),
}


def bounded_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches bounded by bytes, so that long texts do not pile up in one worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))
    home, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):  # workers find this package wherever the driver was started
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (home, env.get("PYTHONPATH"))))


def release() -> None:
    """Give freed memory back to the system, as workers wait for the next task while others need it."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str, together: int = 1) -> DataFrame:
    """Apply fn to every bounded Arrow batch of df, or to so many of them together."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = (b for b in batches if b.num_rows)
        while some := list(islice(filled, together)):
            yield from fn(some[0] if len(some) == 1 else pa.Table.from_batches(some).combine_chunks().to_batches()[0])
        release()

    return df.mapInArrow(run, schema)


def raw(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of every text; null gives none."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """All words of a batch: byte ranges in one buffer, 64-bit hashes, and the first word of each text."""

    def __init__(self, texts: list[bytes], kind: str = "space", lower: bool = False):
        joined = b"\n".join(texts) + b"\n"
        self.data = joined.lower() if lower else joined  # bytes.lower changes A-Z only
        self.buf = np.frombuffer(self.data, np.uint8)
        self.text_start = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])
        inside = KEEP[kind][self.buf]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))  # the last byte is never inside
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.text_start)
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), self.counts)
        self._hash: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = hash_ranges(self.buf, self.start, self.end)
        return self._hash

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Start positions of all runs of n words inside one text, and a 64-bit hash of each."""
        total = len(self) - n + 1
        if total <= 0:
            return np.empty(0, np.int64), np.empty(0, U64)
        h = self.hash
        acc = h[:total].copy()
        for j in range(1, n):
            acc *= U64(0x9E3779B97F4A7C15)
            acc += h[j : j + total]
        ok = self.text[:total] == self.text[n - 1 : n - 1 + total]
        at = np.flatnonzero(ok)
        return at, mix(acc[at])

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]]

    def words(self, at: np.ndarray) -> list[bytes]:
        data = self.data
        return [data[a:b] for a, b in zip(self.start[at].tolist(), self.end[at].tolist())]

    def kept(self, keep: np.ndarray) -> list[bytes]:
        """For every text its words where keep holds, joined by one space."""
        buf = self.buf.copy()
        buf[self.end] = 32  # a byte follows every word, as a line feed ends each text
        take = np.zeros(len(buf) + 1, np.int8)
        take[self.start[keep]] = 1
        take[self.end[keep] + 1] -= 1  # where the next word starts at once, the two cancel out
        mask = np.cumsum(take[:-1], dtype=np.int8).view(bool)
        out, ends = buf[mask].tobytes(), np.concatenate([[0], np.cumsum(mask)])[self.text_start]
        return [out[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def hash_ranges(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each byte range; ranges are in order and don't overlap."""
    out = np.empty(len(start), U64)
    length = end - start
    if not len(start):
        return out
    power = powers(0xD6E8FEB86659FD93, int(length.max()))
    size = np.cumsum(length)
    cuts = [0, *np.unique(np.searchsorted(size, np.arange(SEGMENT, int(size[-1]), SEGMENT)) + 1).tolist(), len(start)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a >= b:
            continue
        n = length[a:b]
        off = np.concatenate([[0], np.cumsum(n)[:-1]])
        within = np.arange(int(n.sum())) - np.repeat(off, n)
        at = within + np.repeat(start[a:b], n)
        terms = (buf[at].astype(U64) + U64(1)) * power[within]
        out[a:b] = np.add.reduceat(terms, off)
    return mix(out + length.astype(U64) * U64(0xA0761D6478BD642F))


def same_ranges(buf: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether byte range a equals byte range b, pair by pair."""
    same = (a_end - a) == (b_end - b)
    at = np.flatnonzero(same)
    for i in range(0, len(at), 1 << 14):
        part = at[i : i + (1 << 14)]
        n = (a_end - a)[part]
        if not n.sum():
            continue
        off = np.concatenate([[0], np.cumsum(n)[:-1]])
        within = np.arange(int(n.sum())) - np.repeat(off, n)
        differ = buf[within + np.repeat(a[part], n)] != buf[within + np.repeat(b[part], n)]
        some = n > 0
        same[part[some]] = np.add.reduceat(differ.astype(np.int64), off[some]) == 0
    return same


def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """An Arrow list column from flat values and the length of each row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def collected(df: DataFrame) -> pd.DataFrame:
    """A table of proven size on the driver, by way of Arrow; what it took on the way is given back."""
    out = df.toArrow().to_pandas()
    release()
    return out


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def remainder(column: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def total_length(column: str = "text"):
    return F.coalesce(F.octet_length(column), F.lit(0))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table that is read more than once to shared storage, and read it back: no lost executor can undo it."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
