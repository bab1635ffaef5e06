"""Quality selection by importance resampling.

Words and pairs of words are hashed to buckets. Two bucket distributions are fitted: of the target (labelled texts of good
quality that are not toxic) and of all raw texts. A text's weight is the ratio of its probabilities under the two, taken for
a text of LENGTH n-grams so that long and short texts compare. With Gumbel noise added to the log weights, the k highest are
a sample without replacement in proportion to the weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from habitus.llm.text import U64, Words, collected, mix, per_batch, raw, stored

BUCKETS = 1 << 16
LENGTH = 128
TARGETS = 20_000  # labelled texts that the target distribution is fitted on, at most
SEED = 17


def buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every word and word pair, and the text that each is in."""
    words = Words(texts, "space")
    at, pairs = words.windows(2)
    h = np.concatenate([mix(words.hash), mix(pairs ^ U64(0x5851F42D4C957F2D))])
    return (h >> U64(48)).astype(np.int64), np.concatenate([words.text, words.text[at]])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in column text; the driver gets a row a bucket."""

    def run(batch: pa.RecordBatch):
        n = np.bincount(buckets(raw(batch.column(0)))[0], minlength=BUCKETS)
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(at), pa.array(n[at])], ["bucket", "n"])

    got = collected(per_batch(texts.select("text"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")))
    out = np.zeros(BUCKETS)
    out[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy()
    return out


def target_ids(labels: DataFrame, most: int = TARGETS) -> tuple[DataFrame, float]:
    """Ids of target texts (at most `most`, by hash), and the share of targets among labelled ids.

    An id is a target if all its labels say good quality and none says toxic; null labels say neither.
    """
    by_id = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        ((F.min(F.coalesce("quality", F.lit(0))) == 1) & (F.max(F.coalesce("toxic", F.lit(0))) == 0)).alias("target"))
    share = by_id.agg(F.avg(F.col("target").cast("int"))).first()[0]
    ids = by_id.filter("target").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return ids, float(share or 0.0)


def log_ratio(target: np.ndarray, everything: np.ndarray) -> np.ndarray:
    p, q = (x + 1 for x in (target, everything))
    return np.log(p / p.sum()) - np.log(q / q.sum())


def weigh(documents: DataFrame, ratio: np.ndarray, length: int = LENGTH) -> DataFrame:
    """doc_id, n_grams, log_weight of every row, and noise from a hash of id and text, so that a lost task repeats it."""
    shared = documents.sparkSession.sparkContext.broadcast(ratio)

    def run(batch: pa.RecordBatch):
        bucket, owner = buckets(raw(batch.column(2)))
        n = np.bincount(owner, minlength=batch.num_rows)
        total = np.bincount(owner, weights=shared.value[bucket], minlength=batch.num_rows)
        u = ((batch.column(1).to_numpy().view(U64) >> U64(12)).astype(float) + 0.5) / 2**52
        yield pa.record_batch([batch.column(0), pa.array(n), pa.array(length * total / np.maximum(n, 1)), pa.array(-np.log(-np.log(u)))], ["doc_id", "n_grams", "log_weight", "gumbel"])

    rows = documents.select("doc_id", F.xxhash64("doc_id", "text", F.lit(SEED)).alias("h"), "text")
    return per_batch(rows, run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_grams long, log_weight double, gumbel double")


def kth_largest(rows: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a column without nulls, exactly, by narrowing histograms of 4,096 bins."""
    value = F.col(column)
    low, high = rows.agg(F.min(value), F.max(value)).first()
    while low < high:
        width = (high - low) / 4096
        bin_ = F.least(F.lit(4095), F.floor((value - F.lit(low)) / F.lit(width))) if width > 0 else F.when(value < high, 0).otherwise(4095)
        bins = rows.filter(value.between(low, high)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
        for b in sorted(bins.collect(), key=lambda r: -r["bin"]):
            if k <= b["n"]:
                low, high = b["low"], b["high"]
                break
            k -= b["n"]
    return low


def resample(documents: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """Per row: doc_id, n_grams, log_weight, gumbel_key and selected.

    k is a share of all rows; by default that of targets among the labels. Null and empty texts have weight 1. Rows repeated
    as a whole have equal keys and are selected together, even if that makes more than k.
    """
    ids, of_targets = target_ids(labels)
    targets = documents.join(F.broadcast(ids), "doc_id", "left_semi")  # TARGETS ids at most
    ratio = log_ratio(bucket_counts(targets), bucket_counts(documents))
    rows = weigh(documents, ratio).select("doc_id", "n_grams", "log_weight", (F.col("log_weight") + F.col("gumbel")).alias("gumbel_key"))
    rows = stored(rows, "weights")
    k = round(rows.count() * (of_targets if share is None else share))
    least = kth_largest(rows, "gumbel_key", k) if k > 0 else float("inf")
    return rows.withColumn("selected", F.col("gumbel_key") >= F.lit(least))
