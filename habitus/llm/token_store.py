"""Token ids in Parquet list columns with chosen encodings, row groups and page indexes.

Texts are dealt by ranges of doc_id, sorted and encoded, and every task writes its range as files of its own. Ids are
dictionary-encoded when a column chunk holds few distinct ones and delta-encoded otherwise (format version 2); n_tokens is
delta-encoded; pages are small and indexed, so a reader can take the metadata columns without the ids, or the ids of a few
documents without the rest. The position of a document among all ids comes from the metadata columns alone.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from habitus.llm.bpe import SliceCache, encode_texts, flat
from habitus.llm.text import bounded_batches, lists, per_batch, raw

TOKENIZER = "byte_bpe_50k.json"
END = 2
ROW_GROUP = 8 << 20  # bytes
PAGE = 64 << 10  # bytes
ROWS_PER_FILE = 50_000
JOINED = 128  # slices that go through the library as one text


@functools.cache
def library_cache(path: str) -> SliceCache:
    """Slices go through the tokenizers library once each; equal slices have equal ids wherever they stand.

    Most are a space and letters. Such slices are joined to long texts, as each call has a price: the library cuts them at
    the spaces again, and a token that starts with a space starts a slice.
    """
    tokenizer = Tokenizer.from_file(path)
    opens = np.zeros(tokenizer.get_vocab_size(), bool)
    space = tokenizer.pre_tokenizer.pre_tokenize_str(" ")[0][0]  # how the vocabulary writes a space
    opens[[i for t, i in tokenizer.get_vocab().items() if t[0] == space]] = True

    def alone(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(pieces: list[bytes]) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
        texts = [p.decode() for p in pieces]
        plain = [i for i, t in enumerate(texts) if t[0] == " " and t[1:].isalpha()]
        order, ids, counts, rest = [], [], [], [i for i, t in enumerate(texts) if not (t[0] == " " and t[1:].isalpha())]
        for some in (plain[k : k + JOINED] for k in range(0, len(plain), JOINED)):
            got = np.array(alone(["".join([texts[i] for i in some])])[0], np.int32)
            cuts = np.flatnonzero(opens[got])
            if len(cuts) == len(some):
                order += some
                ids.append(got)
                counts.append(np.diff(cuts, append=len(got)))
            else:  # not cut at the spaces only
                rest += some
        for x in alone([texts[i] for i in rest]):
            ids.append(np.array(x, np.int32))
            counts.append(np.array([len(x)]))
        return order + rest, ids, counts

    return SliceCache(encode)


@functools.cache
def added_tokens(path: str) -> tuple[re.Pattern[bytes] | None, dict[bytes, int]]:
    """An expression that finds the tokenizer's added tokens, the longest first, and their ids; None if it has none."""
    added = Tokenizer.from_file(path).get_added_tokens_decoder()
    for token in added.values():
        if token.single_word or token.lstrip or token.rstrip or token.normalized:
            raise ValueError(f"added token {token.content!r} is not found by its plain text alone")
    ids = {token.content.encode(): i for i, token in added.items()}
    forms = map(re.escape, sorted(ids, key=len, reverse=True))
    return re.compile(b"(" + b"|".join(forms) + b")") if ids else None, ids


def encode_with_added(texts: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of all texts, and the number of ids of each text.

    As in the library, added tokens come first: texts are cut at them, and what lies between is encoded piece by piece.
    """
    form, known = added_tokens(path)
    if form is None or not any(map(form.search, texts)):
        return encode_texts(texts, library_cache(path))
    pieces, pieces_of, token = [], [], []  # token: the added token behind each piece, -1 at the end of a text
    for text in texts:
        parts = form.split(text)
        pieces += parts[0::2]
        pieces_of.append(len(parts[0::2]))
        token += [*map(known.__getitem__, parts[1::2]), -1]
    ids, n = encode_texts(pieces, library_cache(path))
    behind = np.array(token, np.int32)
    some = behind >= 0
    ids = np.insert(ids, np.cumsum(n)[some], behind[some])
    return ids, np.add.reduceat(n + some, np.cumsum([0, *pieces_of[:-1]]))


def tokenize(df: DataFrame, column: str = "text", tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """doc_id, n_tokens and ids of every row, the end id included. Null and empty texts have the end id alone."""
    path = public_tokenizers.path(tokenizer)

    def run(batch: pa.RecordBatch):
        ids, n = encode_with_added(raw(batch.column(1)), path)
        ids = np.insert(ids, np.cumsum(n), end).astype(np.int32)
        yield pa.record_batch([batch.column(0), pa.array(n + 1), lists(ids, n + 1)], ["doc_id", "n_tokens", "ids"])

    return per_batch(df.select("doc_id", column), run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>")


def write(df: DataFrame, path: str, dictionary: bool = True, row_group: int = ROW_GROUP, page: int = PAGE) -> None:
    """Write rows in ascending doc_id (null first, equal ids next to each other), one range of ids a task.

    dictionary=False delta-encodes the ids. Executors may be lost: Spark writes a range again and commits it once.
    """
    # without columns that clash with those of the store
    ordered = df.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    bounded_batches(df.sparkSession)
    (
        tokenize(ordered).write
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", str(dictionary).lower())
        .option("parquet.block.size", row_group)
        .option("parquet.page.size", page)
        .option("parquet.dictionary.page.size", 1 << 20)
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .option("compression", "zstd")
        .parquet(path)
    )


def positions(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens, start and file of every stored row, from the metadata columns only.

    Files hold ROWS_PER_FILE rows at most, so a window over one file is bounded; the files' totals, one row each, are
    summed in the order of their first ids.
    """
    rows = spark.read.parquet(path).select(
        "doc_id", "n_tokens", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    inside = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"), F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "file")).alias("low"))
    before = Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(files, "file").select("doc_id", "n_tokens", (F.col("base") + F.col("inside")).alias("start"), "file", "at")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """file, at and ids_crc32 of every stored row: crc32 over its ids as little-endian 32-bit integers."""
    rows = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"), "ids")

    def run(batch: pa.RecordBatch):
        ids, n = flat(batch.column(2))
        data = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
        stop = (4 * np.cumsum(n)).tolist()
        crc = [zlib.crc32(data[b - 4 * k : b]) for b, k in zip(stop, n.tolist())]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(crc, pa.int64())], ["file", "at", "ids_crc32"])

    return per_batch(rows, run, "file string, at long, ids_crc32 long")


def read_tokens(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """The ids of documents low to high (both included); the filter reaches the page index."""
    return spark.read.parquet(path).filter(F.col("doc_id").between(low, high))


def report(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every stored row."""
    return positions(spark, path).join(checksums(spark, path), ["file", "at"]).select("doc_id", "start", "n_tokens", "ids_crc32")
