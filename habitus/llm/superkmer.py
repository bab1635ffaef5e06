"""Repeated passages found exactly by super-k-mer partitioning.

A window is WINDOW consecutive words. Its minimiser is the least hash among the short word runs inside it, and consecutive
windows that share a minimiser travel together as one packed string to the minimiser's bucket, so a text is sent about three
times instead of WINDOW times. Equal windows have equal minimisers and meet in one bucket, where sorting finds the first
occurrence of each; hashes order the windows, bytes decide.

Two things keep buckets even. Windows repeated within one batch of texts are settled there, and only the first of each
travels. Short runs that are very common rank last, so a window has one as minimiser only if it consists of such runs, and
those windows are the same everywhere and settled within the batches. What counts as common comes from a pass over all
texts; it steers the partitioning and never the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from habitus.llm.text import U64, Words, collected, lists, per_batch, raw, same_ranges, sha256, stored

WINDOW, RUN = 20, 3
COMMON = 1 << 14  # a run is common if it makes up one in so many; at most so many runs are
BUCKET_WORDS = 500_000  # words of text for each bucket


def common_runs(documents: DataFrame, size: int, kind: str = "space", lower: bool = False, column: str = "text") -> tuple[np.ndarray, int]:
    """Sorted hashes of the runs of `size` words that make up at least one in COMMON of all runs, and the number of words.

    Every batch of texts counts its runs and reports those above a quarter of that share; a common run is above it in some
    batches, so its count is short by a quarter at most. COMMON hashes at most come to the driver.
    """

    def run(batch: pa.RecordBatch):
        words = Words(raw(batch.column(0)), kind, lower)
        _, h = words.windows(size)
        found, n = np.unique(h, return_counts=True)
        some = n >= max(8, len(h) // (4 * COMMON))
        yield pa.record_batch([pa.array([None] + found[some].view(np.int64).tolist(), pa.int64()), pa.array([len(words)] + n[some].tolist(), pa.int64())], ["hash", "n"])

    counts = stored(per_batch(documents.select(column), run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "runs")
    total = (counts.filter("hash IS NULL").agg(F.sum("n")).first()[0]) or 0
    rows = collected(counts.filter(F.col("hash").isNotNull() & (F.col("n") >= max(8, total * 3 // (4 * COMMON)))).select("hash"))
    return np.sort(rows["hash"].to_numpy(np.int64).view(U64)), int(total)


def ranked(h: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Ranks in the order of hashes, common ones last."""
    out = h >> U64(1)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        out |= (common[at] == h).astype(U64) << U64(63)
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i:i + width] for every i that has so many."""
    have = 1
    while have * 2 <= width:
        x, have = np.minimum(x[:-have], x[have:]), have * 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def first_of(words: Words, at: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """For every window (in order of occurrence) the index of the first window with the same words.

    Words must be separated by one byte. Hashes bring equal windows together; bytes decide, also among equal hashes.
    """
    order = np.argsort(h, kind="stable")
    sorted_h = h[order]
    new = np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]]) if len(h) else np.empty(0, bool)
    lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(h) else order
    out = np.arange(len(h))
    out[order] = lead
    again = np.flatnonzero(out != np.arange(len(h)))
    a, b = at[again], at[out[again]]
    same = same_ranges(words.buf, words.start[a], words.end[a + n - 1], words.start[b], words.end[b + n - 1])
    if not same.all():  # different windows with one hash
        for bad in np.unique(h[again[~same]]):
            seen: dict[bytes, int] = {}
            for i in np.sort(order[np.searchsorted(sorted_h, bad, "left") : np.searchsorted(sorted_h, bad, "right")]).tolist():
                out[i] = seen.setdefault(words.data[words.start[at[i]] : words.end[at[i] + n - 1]], i)
    return out


def ranges(owner: np.ndarray, start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge windows of n words that follow each other in one text into (owner, from, to) ranges; input is in order."""
    if not len(owner):
        return owner, start, start
    cut = np.flatnonzero((owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)) + 1
    low, high = np.concatenate([[0], cut]), np.concatenate([cut, [len(owner)]]) - 1
    return owner[low], start[low], start[high] + n


def pack(documents: DataFrame, common: np.ndarray, buckets: int, window: int, run: int) -> DataFrame:
    """Rows for the buckets: packed super-k-mers with (doc, mark, start) each, or ranges settled within the batch."""
    shared = documents.sparkSession.sparkContext.broadcast(common)  # COMMON hashes at most

    def fn(batch: pa.RecordBatch):
        doc, mark = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        order = np.lexsort((mark, doc))
        doc, mark = doc[order], mark[order]
        again = np.concatenate([[False], (doc[1:] == doc[:-1]) & (mark[1:] == mark[:-1])])
        texts = [t for t, skip in zip((raw(batch.column(2).take(pa.array(order)))), again) if not skip]  # a repeated row is the same text
        doc, mark = doc[~again], mark[~again]
        words = Words(Words(texts).kept(slice(None)))
        at, h = words.windows(window)
        first = first_of(words, at, h, window)
        travels = first == np.arange(len(at))
        text, inside = words.text[at], at - words.first[words.text[at]]
        who, low, high = ranges(text[~travels], inside[~travels], window)
        out = [(int(doc[0]) % buckets, None, doc[who], mark[who], low, high)] if len(who) else []
        if len(at):
            short_at, short = words.windows(run)
            rank = np.full(len(words), ~U64(0))
            rank[short_at] = ranked(short, shared.value)
            least = sliding_min(rank, window - run + 1)[at]
            go = np.flatnonzero(travels)
            joined = (np.diff(at[go]) == 1) & (least[go][1:] == least[go][:-1]) & (text[go][1:] == text[go][:-1])
            cut = np.flatnonzero(~joined) + 1
            a, b = go[np.concatenate([[0], cut])], go[np.concatenate([cut, [len(go)]]) - 1]
            bucket = (least[a] % U64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            a, b, bucket = a[by], b[by], bucket[by]
            begin, end, data = words.start[at[a]].tolist(), words.end[at[b] + window - 1].tolist(), words.data
            edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]).tolist()
            zip_ = zstandard.ZstdCompressor(level=3)
            for x, y in zip(edges[:-1], edges[1:]):
                blob = zip_.compress(b"\n".join([data[s:e] for s, e in zip(begin[x:y], end[x:y])]))
                t = text[a[x:y]]
                out.append((int(bucket[x]), blob, doc[t], mark[t], inside[a[x:y]], inside[a[x:y]]))
        n = np.array([len(o[2]) for o in out], np.int64)
        cat = lambda i: lists(np.concatenate([o[i] for o in out]).astype(np.int64) if out else np.empty(0, np.int64), n)
        yield pa.record_batch(
            [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary()), cat(2), cat(3), cat(4), cat(5)],
            ["bucket", "packed", "doc", "mark", "low", "high"])

    return per_batch(documents, fn, "bucket long, packed binary, doc array<bigint>, mark array<bigint>, low array<bigint>, high array<bigint>", together=2)


def settle(table: pa.Table, window: int) -> pa.Table:
    """One bucket: the ranges of windows that occur before, and those that the batches have settled."""
    table = table.combine_chunks()
    done = table.filter(pc.is_null(table["packed"]))
    parts = [[done[c].combine_chunks().flatten() for c in ("doc", "mark", "low", "high")]]
    live = table.filter(pc.is_valid(table["packed"]))
    if len(live):
        unzip = zstandard.ZstdDecompressor()
        texts = [t for blob in live["packed"].to_pylist() for t in unzip.decompress(blob).split(b"\n")]
        doc, mark, low = (live[c].combine_chunks().flatten().to_numpy() for c in ("doc", "mark", "low"))
        order = np.lexsort((low, mark, doc))
        words = Words([texts[i] for i in order.tolist()])
        doc, mark, low = doc[order], mark[order], low[order]
        at, h = words.windows(window)
        first = first_of(words, at, h, window)
        text = words.text[at]
        start = low[text] + at - words.first[text]
        other = (doc[text] != doc[text[first]]) | (mark[text] != mark[text[first]]) | (start != start[first])  # a repeated row may be here twice
        who, a, b = ranges(text[other], start[other], window)
        parts.append([doc[who], mark[who], a, b])
    columns = [np.concatenate([np.asarray(p[i], np.int64) for p in parts]) for i in range(4)]
    return pa.table(dict(zip(("doc", "mark", "low", "high"), columns)))


def repeated_ranges(documents: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """(doc, mark, low, high): word ranges of windows whose words also start earlier, from columns doc, mark and text."""
    common, words = common_runs(documents, run)
    buckets = max(1, -(-words // BUCKET_WORDS))
    packed = pack(documents, common, buckets, window, run)
    return packed.groupBy("bucket").applyInArrow(lambda t: settle(t, window), "doc long, mark long, low long, high long")


def dedup(documents: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and kept (the words left, joined by one space).

    A word goes if a window over it has the words of a window that starts earlier: in a smaller doc_id, or earlier in the
    same document. Null texts have no words. Null ids come first; rows with equal ids and different texts come in the order
    of a hash of the text; a row repeated as a whole is one document, and each of its copies gets the same result.
    """
    rows = documents.select(
        "doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("doc"), F.xxhash64("text").alias("mark"), "text")
    gone = repeated_ranges(rows.select("doc", "mark", "text"), window, run)
    gone = gone.groupBy("doc", "mark").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high"))
    joined = rows.join(gone, ["doc", "mark"], "left").select("doc_id", "text", "low", "high")

    def run_(batch: pa.RecordBatch):
        words = Words(raw(batch.column(1)))
        step = np.zeros(len(words) + 1, np.int64)
        for column, add in ((2, 1), (3, -1)):
            at = batch.column(column)
            n = pc.fill_null(pc.list_value_length(at), 0).to_numpy()
            np.add.at(step, at.flatten().to_numpy() + np.repeat(words.first[:-1], n), add)
        keep = np.cumsum(step[:-1]) == 0
        kept = words.kept(keep)
        left = np.concatenate([[0], np.cumsum(keep)])[words.first]
        yield pa.record_batch(
            [batch.column(0), pa.array(words.counts), pa.array(words.counts - np.diff(left)), pa.array([sha256(k) for k in kept], pa.string()),
             pa.array([k.decode("utf-8", "replace") for k in kept], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return per_batch(joined, run_, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")
