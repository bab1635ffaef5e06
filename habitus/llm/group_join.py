"""Jaccard similarity join over word shingles through a matrix of tokens and groups.

A text is the set of its distinct shingles (tokens). Two texts link at a Jaccard similarity of PERCENT or more, so each must
hold one of the other's first n - ceil(PERCENT n) + 1 tokens in any fixed order: its prefix. Tokens are ordered by hash,
common ones last, so prefixes meet rarely unless texts are alike.

Similar texts form groups of one key token and one size band. The matrix says which tokens a group's texts hold; for a
query it bounds the overlap with every text of the group, and only groups that pass are opened: their texts are fetched, the
bound is taken again with the union of all their tokens, and the rest is compared exactly. A third of all texts may be near
copies of one. Groups are therefore split, and each part is linked inside first, around shared pivots; after that a query
leaves out every part that is connected to it already, because more links there cannot change a component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from habitus.llm.components import components
from habitus.llm.text import U64, Words, collected, lists, mix, per_batch, raw, stored
from habitus.llm.superkmer import ranked

SHINGLE, PERCENT = 4, 85
COUNTED_PERCENT, COUNTED_MORE = 25, 4  # of each text's tokens in the order of hashes, those whose frequency is counted
LEAST_COMMON = 4  # a token counted so often is common,
COMMON = 1 << 20  # unless there are more of them than these (8 MB): then only the most frequent are
PART = 256  # texts of a group that are opened together
QUERIES = 256  # queries that one task compares with an opened group


def token_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of each text by ascending hash, and the number of each text. Short texts are one token."""
    words = Words(texts, "space", lower=True)
    at, h = words.windows(size)
    owner = words.text[at]
    for k in range(1, size):
        short = np.flatnonzero(words.counts == k)
        if len(short):
            at_k, h_k = words.windows(k)
            whole = np.isin(words.text[at_k], short)
            owner, h = np.concatenate([owner, words.text[at_k][whole]]), np.concatenate([h, mix(h_k[whole] + U64(k))])
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.empty(0, bool)
    return h[new], np.bincount(owner[new], minlength=len(texts))


def least_overlap(n, percent: int):
    return (percent * n + 99) // 100


def first_tokens(tokens: np.ndarray, counts: np.ndarray, take: np.ndarray) -> np.ndarray:
    """A mask of the first take[i] tokens of every text i."""
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(counts) - counts, counts)
    return place < np.repeat(take, counts)


def common_tokens(documents: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of common tokens, counted over all texts. Prefixes lie among low hashes, so only those are counted."""

    def run(batch: pa.RecordBatch):
        tokens, n = token_sets(raw(batch.column(0)), size)
        take = -(-COUNTED_PERCENT * n // 100) + COUNTED_MORE
        found, times = np.unique(tokens[first_tokens(tokens, n, take)], return_counts=True)
        yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(times)], ["token", "n"])

    step = F.floor(F.log("n") / F.log(F.lit(1.1)))
    counts = per_batch(documents.select("text"), run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COMMON)
    counts = stored(counts.withColumn("step", step), "tokens")
    steps = collected(counts.groupBy("step").agg(F.count("*").alias("tokens"))).sort_values("step", ascending=False)  # a few hundred rows
    fits = steps[steps["tokens"].cumsum() <= COMMON]["step"]
    if not len(fits):
        return np.empty(0, U64)
    return np.sort(collected(counts.filter(F.col("step") >= int(fits.min())).select("token"))["token"].to_numpy(np.int64).view(U64))


def sets(documents: DataFrame, common: np.ndarray, size: int, percent: int) -> DataFrame:
    """doc_id, doc, mark, n (tokens), a 128-bit digest of the token set, and its prefix."""
    shared = documents.sparkSession.sparkContext.broadcast(common)  # COMMON hashes at most

    def run(batch: pa.RecordBatch):
        tokens, n = token_sets(raw(batch.column(3)), size)
        rank = ranked(tokens, shared.value)
        owner = np.repeat(np.arange(len(n)), n)
        by = np.lexsort((rank, owner))
        prefix = first_tokens(tokens, n, np.where(n > 0, n - least_overlap(n, percent) + 1, 0))
        digest = []
        for salt in (U64(0x2545F4914F6CDD1D), U64(0x9E6C63D0876A9A47)):
            total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(tokens ^ salt))])
            end = np.cumsum(n)
            digest.append((total[end] - total[end - n]).view(np.int64))
        kept = tokens[by][prefix].view(np.int64)
        yield pa.record_batch(
            [*batch.columns[:3], pa.array(n.astype(np.int64)), *map(pa.array, digest), lists(kept, np.bincount(owner[prefix], minlength=len(n)))],
            ["doc_id", "doc", "mark", "n", "hi", "lo", "prefix"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return per_batch(documents.select("doc_id", "doc", "mark", "text"), run, f"doc_id {kind}, doc long, mark long, n long, hi long, lo long, prefix array<bigint>")


class Opened:
    """The token sets of a few texts: their union, and for each token of the union the texts that hold it."""

    def __init__(self, texts: list[bytes], size: int):
        tokens, self.n = token_sets(texts, size)
        owner = np.repeat(np.arange(len(texts)), self.n)
        order = np.argsort(tokens, kind="stable")
        self.owner = owner[order]
        self.union, self.start, self.count = np.unique(tokens[order], return_index=True, return_counts=True)

    def overlaps(self, query: np.ndarray, percent: int) -> np.ndarray | None:
        """The overlap of a query's tokens with each text, or None if the union holds too few of them."""
        if not len(self.union):
            return None
        at = np.minimum(np.searchsorted(self.union, query), len(self.union) - 1)
        at = at[self.union[at] == query]
        if len(at) < least_overlap(len(query), percent):
            return None
        n = self.count[at]
        held = np.arange(int(n.sum())) + np.repeat(self.start[at] - (np.cumsum(n) - n), n)
        return np.bincount(self.owner[held], minlength=len(self.n))


def linked(overlap: np.ndarray, n: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    return 100 * overlap >= percent * (n + sizes - overlap)


def link_inside(table: pa.Table, size: int, percent: int) -> pa.Table:
    """Links that connect the texts of one part as far as they link; a text already connected to all before it is skipped."""
    rows = table["row"].to_numpy()
    texts = raw(table["text"].combine_chunks())
    opened, (tokens, n) = Opened(texts, size), token_sets(texts, size)
    end, label, out = np.cumsum(n), np.arange(len(rows)), []
    for i in range(1, len(rows)):
        overlap = opened.overlaps(tokens[end[i] - n[i] : end[i]], percent)
        if overlap is None:
            continue
        for j in np.flatnonzero(linked(overlap, n[i], n, percent)[:i]).tolist():
            if label[i] != label[j]:
                out.append((rows[i], rows[j]))
                label[label == label[i]] = label[j]
    return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})


def link_queries(table: pa.Table, size: int, percent: int) -> pa.Table:
    """Links between each query and the opened part: one for every component above the query's own that it meets."""
    query = table["query"].to_numpy(zero_copy_only=False)
    rows, label, texts = table["row"].to_numpy(), table["label"].to_numpy(), raw(table["text"].combine_chunks())
    member = np.flatnonzero(~query)
    opened = Opened([texts[i] for i in member], size)
    asked = np.flatnonzero(query)
    tokens, n = token_sets([texts[i] for i in asked], size)
    end, out = np.cumsum(n), []
    for k, i in enumerate(asked.tolist()):
        overlap = opened.overlaps(tokens[end[k] - n[k] : end[k]], percent)
        if overlap is None:
            continue
        hit = member[linked(overlap, n[k], opened.n, percent)]
        met, first = np.unique(label[hit], return_index=True)
        out += [(rows[i], rows[j]) for j in hit[first[met > label[i]]].tolist()]
    return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})


def parts(rows: DataFrame, *keys: str) -> DataFrame:
    """Add a part to the rows of each group (by keys), so that parts hold about PART texts, and the group's two pivots.

    One pivot is the text whose tokens are held most often, which has fewest words of its own; the other is any text.
    """
    central, any_row = F.struct("weight", "row"), F.struct(F.xxhash64("row"), "row")
    count = rows.groupBy(*keys).agg(
        F.ceil(F.count("*") / PART).alias("of"), F.count("*").alias("texts"), F.max(central).row.alias("low"), F.min(any_row).row.alias("high"))
    return rows.join(stored(count, "groups"), [*keys]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("of")))


def with_text(tasks: DataFrame, place: DataFrame, documents: DataFrame) -> DataFrame:
    """Add the text to rows that name a row."""
    return tasks.join(place, "row").join(documents, ["doc", "mark"]).drop("doc", "mark")


def first_links(alike: DataFrame, place: DataFrame, documents: DataFrame, size: int, percent: int) -> DataFrame:
    """Links inside each part of each group of one key token; the group's pivots are in all of its parts."""
    grouped = stored(parts(alike, "key").filter("texts > 1").select("key", "part", "of", "row", "low", "high"), "groups")
    pivots = grouped.filter("of > 1").select("key", "of", F.explode(F.array("low", "high")).alias("row")).distinct()
    pivots = pivots.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)).alias("part"), "row")
    tasks = grouped.select("key", "part", "row").union(pivots).distinct()
    return with_text(tasks, place, documents).groupBy("key", "part").applyInArrow(lambda t: link_inside(t, size, percent), "a long, b long")


def bound(percent: int) -> F.Column:
    """Whether count shared prefix tokens allow a link between n tokens and some number from lo to hi.

    If the prefix of n ends first in the order, n's own tokens outside the shared ones are missing in the other text, and the
    other way round, so the overlap is at most count + max(n, m) - prefix length; the overlap that a link takes is
    percent (n + m) / (100 + percent). Their difference is least at an end of the range of m.
    """
    n, share = F.col("n"), percent / 100
    low, high = F.greatest(F.col("lo"), share * n), F.least(F.col("hi"), n / share)
    lack = lambda m: share * (n + m) / (1 + share) - share * F.greatest(n, m)
    return F.col("count") >= F.least(lack(low), lack(high)) - 1e-6


def later_links(postings: DataFrame, texts: DataFrame, place: DataFrame, documents: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between texts of different components so far: queries against the matrix, then against opened groups."""
    banded = texts.withColumn("band", F.floor(F.log("n") / F.log(F.lit(1.04))))
    member = stored(parts(banded, "key", "band").select("row", "n", "label", F.xxhash64("key", "band", "part").alias("group")), "members")
    placed = stored(postings.join(member, "row").select("token", "row", "n", "label", "group"), "placed")
    matrix = placed.groupBy("token", "group").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("label").alias("other"))
    asked = placed.select("token", F.col("row").alias("q"), "n", "label")
    pairs = (
        asked.join(matrix, "token").filter("label < other").filter((percent * F.col("lo") <= 100 * F.col("n")) & (100 * F.col("hi") >= percent * F.col("n")))
        .groupBy("q", "group").agg(F.count("*").alias("count"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("n").alias("n"))
        .filter(bound(percent)).select("q", "group")
    )
    pairs = stored(pairs, "openings")
    tasks = stored(pairs.groupBy("group").agg(F.ceil(F.count("*") / QUERIES).alias("of")), "openings")
    queries = pairs.join(tasks, "group").select("group", F.pmod(F.xxhash64("q"), F.col("of")).alias("salt"), F.col("q").alias("row"), F.lit(True).alias("query"))
    opened = member.join(tasks, "group").select(
        "group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)).alias("salt"), "row", F.lit(False).alias("query"))
    labels = member.select("row", "label")
    work = with_text(queries.union(opened).join(labels, "row"), place, documents)
    return work.groupBy("group", "salt").applyInArrow(lambda t: link_queries(t, size, percent), "a long, b long")


def keyed(documents: DataFrame, *more: str) -> DataFrame:
    """doc and mark, which tell rows apart by id and text, beside doc_id, text and other columns."""
    return documents.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("doc"), F.xxhash64("text").alias("mark"), "text", *more)


def link(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """One row a document (doc_id, doc, mark, n, hi, lo), and one a class of equal sets: hi, lo, its component, and the
    class's first document as (null id?, doc, mark)."""
    docs = keyed(documents)
    rows = stored(sets(docs, common_tokens(docs, size), size, percent).withColumn("row", F.monotonically_increasing_id()), "sets")
    some, texts = rows.filter("n > 0"), docs.select("doc", "mark", "text")
    # classes of equal sets; one row stands for each
    classes = stored(some.groupBy("hi", "lo").agg(F.min("row").alias("row"), F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc", "mark")).alias("least")), "classes")
    tokens = some.select(F.explode("prefix").alias("token"), "row", "n", "hi")
    shared = tokens.groupBy("token").agg(F.min("hi").alias("x"), F.max("hi").alias("y"), F.count("*").alias("often")).filter("x < y").select("token", "often")
    postings = stored(tokens.select("token", "row", "n").join(shared, "token").join(classes.select("row"), "row", "left_semi"), "postings")
    active = postings.groupBy("row").agg(F.first("n").alias("n"), F.count("*").alias("held"), F.max(F.struct("often", "token")).token.alias("key"), F.sum("often").alias("weight"))
    active = stored(active, "active")
    place = rows.select("row", "doc", "mark").join(active.select("row"), "row", "left_semi")
    # whichever texts are taken here, the second step finds all links that are left
    alike = active.filter(F.col("held") >= F.greatest(F.lit(2.0), 0.3 * (1 - percent / 100) * F.col("n"))).select("row", "key", "weight")
    links = stored(first_links(alike, place, texts, size, percent), "links")
    so_far = components(links)
    labelled = active.join(so_far.withColumnRenamed("node", "row"), "row", "left").select("row", "n", "key", "weight", F.coalesce("component", "row").alias("label"))
    more = stored(later_links(postings.drop("n"), labelled, place, texts, size, percent), "links")
    found = components(links.union(more))
    return rows, classes.join(found.withColumnRenamed("node", "row"), "row", "left").select("hi", "lo", "least", F.coalesce("component", "row").alias("component"))


def link_components(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the least doc_id that links reach.

    Null and empty texts have no shingles and stay alone. Rows with equal ids are documents of their own that share the id;
    a null id is the least only where a component has no other.
    """
    rows, node = link(documents, size, percent)
    least = node.groupBy("component").agg(F.min("least").alias("first"))
    kind = rows.schema["doc_id"].dataType
    first = F.when(~F.col("first.null"), F.col("first.doc")).cast(kind)
    by_class = node.join(least, "component").select("hi", "lo", first.alias("component_id"))
    joined = rows.select("doc_id", "n", "hi", "lo").join(by_class.withColumn("any", F.lit(True)), ["hi", "lo"], "left")
    alone = F.col("any").isNull() | (F.col("n") == 0)
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def first_of_each(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of documents that stay if one of each component does: the one with the least id. Rows without shingles stay."""
    rows, node = link(documents, size, percent)
    first = node.groupBy("component").agg(F.min("least").alias("first")).select("first.doc", "first.mark", F.lit(False).alias("empty"))
    stay = first.union(rows.filter("n = 0").select("doc", "mark", F.lit(True)).distinct())
    # the names of other columns may clash with ours
    inside = {c: f"other_{i}" for i, c in enumerate(documents.columns) if c not in ("doc_id", "text")}
    docs = keyed(documents.toDF(*(inside.get(c, c) for c in documents.columns)), *inside.values())
    once = F.when(F.col("empty"), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    kept = docs.join(stay, ["doc", "mark"]).withColumn("once", once).dropDuplicates(["doc", "mark", "once"])
    return kept.select(*(F.col(inside.get(c, c)).alias(c) for c in documents.columns))
