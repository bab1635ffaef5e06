"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item gives windows of WINDOW consecutive words (an item with fewer words is one window). A document holds a
window only if it holds all of the window's shingles, so with containment 1 the necessary prefix of a window is a single
shingle; shingles are ordered by how often the documents have them, and the rarest one of each window is joined. A meeting
fixes where the window would have to start; windows that would leave the document are dropped by length, and the rest are
compared word by word.

Documents are first thinned by a bitmap of fixed size over all benchmark shingles: it only drops positions that cannot
match, and at any benchmark size what it lets through is verified, so results never depend on it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from habitus.llm.text import U64, Words, collected, per_batch, raw, stored

WINDOW, SHINGLE = 10, 5
BITS = 24  # of the bitmap: 2 MB, whatever the benchmark's size


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    at, h = words.windows(size)
    return at, h + U64(size)


def item_windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """item_id, n (words of the window), key (its words) and its distinct shingles with their first offset."""

    def run(batch: pa.RecordBatch):
        words = Words(raw(batch.column(1)), "alnum", lower=True)
        item, size, key, shingles = [], [], [], []
        for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
            n = min(window, b - a)
            if n == 0:
                continue
            k = min(shingle, n)
            own = Words([words.data[words.start[a] : words.end[b - 1]]], "alnum")
            _, h = shingle_hashes(own, k)
            h = h.view(np.int64).tolist()
            parts = own.words(np.arange(len(own)))
            for s in range(b - a - n + 1):
                item.append(i)
                size.append(n)
                key.append(b" ".join(parts[s : s + n]).decode("utf-8", "replace"))
                first: dict[int, int] = {}
                for o in range(n - k + 1):
                    first.setdefault(h[s + o], o)
                shingles.append([{"hash": x, "offset": o} for x, o in first.items()])
        yield pa.record_batch(
            [batch.column(0).take(pa.array(item, pa.int32())), pa.array(size, pa.int64()), pa.array(key, pa.string()),
             pa.array(shingles, pa.list_(pa.struct([("hash", pa.int64()), ("offset", pa.int32())])))], ["item_id", "n", "key", "shingles"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return per_batch(benchmark.select("item_id", "text"), run, f"item_id {kind}, n long, key string, shingles array<struct<hash:bigint,offset:int>>")


def bitmap(hashes: DataFrame) -> np.ndarray:
    """2^BITS bits, one set for every hash of the column; the driver gets 2 MB at most."""
    words = hashes.select(F.shiftrightunsigned("hash", 64 - BITS).alias("bit")).distinct()
    rows = words.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 AS int)))").alias("bits"))
    out = np.zeros(1 << (BITS - 6), np.int64)
    got = collected(rows)
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return out.view(U64)


def document_hits(documents: DataFrame, bits, sizes: list[int], window: int) -> DataFrame:
    """One row a document: its number of words, and the positions whose shingle may be in the benchmark.

    Each hit carries the words around it that a window through it can reach, so verification needs no second look.
    """
    filled = documents.sparkSession.sparkContext.broadcast(bits)

    def run(batch: pa.RecordBatch):
        words, table = Words(raw(batch.column(1)), "alnum", lower=True), filled.value
        positions, hashes = [np.empty(0, np.int64)], [np.empty(0, U64)]
        for k in sizes:
            at, h = shingle_hashes(words, k)
            bit = h >> U64(64 - BITS)
            hit = (table[(bit >> U64(6)).astype(np.int64)] >> (bit & U64(63))) & U64(1) == 1
            positions.append(at[hit])
            hashes.append(h[hit])
        at, h = np.concatenate(positions), np.concatenate(hashes)
        order = np.argsort(at, kind="stable")
        at, h = at[order], h[order]
        text = words.text[at]
        low = np.maximum(at - window + 1, words.first[text])
        high = np.minimum(at + window, words.first[text + 1])
        around = [b" ".join(words.words(np.arange(i, j))) for i, j in zip(low.tolist(), high.tolist())]
        values = pa.StructArray.from_arrays(
            [pa.array(h.view(np.int64)), pa.array(at - words.first[text]), pa.array(low - words.first[text]), pa.array([a.decode("utf-8", "replace") for a in around], pa.string())],
            ["hash", "at", "low", "around"])
        n = np.bincount(text, minlength=batch.num_rows) if len(text) else np.zeros(batch.num_rows, np.int64)
        hits = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), values)
        yield pa.record_batch([batch.column(0), pa.array(words.counts.astype(np.int64)), hits], ["doc_id", "n_words", "hits"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return per_batch(documents.select("doc_id", "text"), run, f"doc_id {kind}, n_words long, hits array<struct<hash:bigint,at:bigint,low:bigint,around:string>>")


def matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One row a document (row, doc_id, n_words), one row an occurrence (row, start, n, key), and the stored item windows.

    Documents and benchmark rows with null or empty text have no words; repeated rows are matched each on its own.
    """
    windows = stored(item_windows(benchmark, window, shingle), "windows")
    bench = windows.select(F.explode("shingles").alias("s")).select(F.col("s.hash").alias("hash"))
    sizes = sorted(min(shingle, r.n) for r in windows.select("n").distinct().collect())  # at most `window` values
    rows = stored(document_hits(documents, bitmap(bench), sizes, window).withColumn("row", F.monotonically_increasing_id()), "hits")
    hits = rows.filter(F.size("hits") > 0).select("row", "n_words", F.explode("hits").alias("h")).select("row", "n_words", "h.*")
    # the order of shingles: how often the documents have them, then the hash
    common = hits.groupBy("hash").agg(F.count("*").alias("often"))
    keys = windows.groupBy("key", "n").agg(F.first("shingles").alias("shingles")).select("key", "n", F.explode("shingles").alias("s"))
    prefix = (
        keys.select("key", "n", F.col("s.hash").alias("hash"), F.col("s.offset").alias("offset")).join(common, "hash", "left")
        .groupBy("key", "n").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "hash", "offset")).alias("p"))
        .filter("p.often > 0").select("key", "n", F.col("p.hash").alias("hash"), F.col("p.offset").alias("offset"))
    )
    found = (
        hits.join(prefix, "hash")
        .withColumn("start", F.col("at") - F.col("offset"))
        .filter("start >= 0 AND start + n <= n_words")  # position and length
        .filter(F.expr("array_join(slice(split(around, ' '), cast(start - low + 1 as int), cast(n as int)), ' ') = key"))  # exactly
        .select("row", "start", "n", "key").distinct()
    )
    return rows.select("row", "doc_id", "n_words"), found, windows


def covered(found: DataFrame) -> DataFrame:
    """row and n_hit: the number of words inside any occurrence, windows of any length."""
    order = Window.partitionBy("row").orderBy("start", "n")
    before = F.max(F.col("start") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest("start", F.coalesce(before, F.lit(0))))
    return found.select("row", "start", "n").distinct().select("row", new.alias("new")).groupBy("row").agg(F.sum("new").alias("n_hit"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, items (their ids as sorted strings), contaminated.

    Every input row gives one row, also those with null ids or texts; items with null ids are left out of items.
    """
    rows, found, windows = matches(documents, benchmark, window, shingle)
    found = stored(found, "occurrences")
    owners = windows.filter("item_id IS NOT NULL").select("key", F.col("item_id").cast("string").alias("item")).distinct()
    items = found.select("row", "key").distinct().join(owners, "key").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<string>")
    return (
        rows.join(covered(found).join(items, "row", "left"), "row", "left")
        .select(
            "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"))
        .select(
            "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "items", (F.col("n_hit") > 0).alias("contaminated"))
    )
