"""Brown class-based bigram model: exchange clustering over all training texts, and scores of whole texts.

log p(text) = sum over tokens of log p(class | context) + log p(word | class). The CLUSTERED most frequent words are dealt
to CLASSES classes by exchange: word after word goes to the class that raises the likelihood of the training texts most,
with the class bigram counts kept up to date in between, in sweeps over all of them until under STILL of the words move. The
likelihood never falls. Their bigram counts are at most (CLUSTERED + SHAPES + 1)^2 numbers, which one task holds.

Every other counted word then joins the class that raises the likelihood most, given what stands before it in all training
texts, word by word in Spark. A context is the class of the word before, if that is one of the clustered words, or else its
shape, which needs no table. So what follows a word does not depend on the class of a word outside the bounded table, and
only what precedes it decides its class. Words never seen in training have the class of their shape; contexts of words
seen once say how likely these are. Each text ends with one end token of its own class.

Word counts grow with the input and stay in Spark. Scoring knows the FREQUENT most frequent words by hash (a table of fixed
size); every other word of a text travels, once with each context and its number, to a join with all counts and classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from habitus.llm.text import U64, Words, bounded_batches, collected, per_batch, raw, release, remainder, stored

CLASSES, CLUSTERED, FREQUENT = 64, 4096, 65_536
STILL = 0.005  # share of the clustered words that still move in a last sweep
SHAPES = 24  # 4 x 2 x 3
DELTA = 0.1  # added to every word's count within its class
BACKOFF = 20.0  # weight of the class frequencies in a transition
END = CLASSES + SHAPES  # the class of the end token, and of what stands before a text
ALL = END + 1
TOGETHER = 8 << 20  # bytes of text whose words are counted together before they are sent


def shape(words: Words, at: np.ndarray) -> np.ndarray:
    """The shape class of words: last byte, whether there are bytes over 127, and three bands of length."""
    if not len(at):
        return np.empty(0, np.int64)
    start, end = words.start[at], words.end[at]
    wide = np.concatenate([[0], np.cumsum(words.buf > 127)])
    last = words.buf[end - 1]
    letter = ((last >= 97) & (last <= 122)) | (last > 127)
    tail = np.where(letter, 0, np.where(last == 44, 1, np.where(last == 46, 2, 3)))
    band = np.digitize(end - start, (6, 11))
    return CLASSES + (tail * 2 + (wide[end] > wide[start])) * 3 + band


def grouped_batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[bytes]]:
    texts, size = [], 0
    for batch in batches:
        for t in raw(batch.column(column)):
            texts.append(t)
            size += len(t)
        if size >= TOGETHER:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def word_counts(texts: DataFrame) -> DataFrame:
    """word, shape and n of every word of column text; the null word counts the texts, that is the end tokens."""
    bounded_batches(texts.sparkSession)

    def run(batches):
        for group in grouped_batches(batches, 0):
            words = Words(group, "space", lower=True)
            _, first, n = np.unique(words.hash, return_index=True, return_counts=True)
            names = [w.decode("utf-8", "replace") for w in words.words(first)]
            yield pa.record_batch(
                [pa.array([None, *names], pa.string()), pa.array(np.concatenate([[END], shape(words, first)])), pa.array(np.concatenate([[len(group)], n]))],
                ["word", "shape", "n"])
        release()

    return texts.select("text").mapInArrow(run, "word string, shape long, n long").groupBy("word").agg(F.first("shape").alias("shape"), F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """At most `most` words of the highest counts, told apart in steps of 2 %; of the step that fits in part, those of the least
    hashes, by buckets."""
    words = counts.filter("word IS NOT NULL").withColumns({"step": F.floor(F.log("n") / F.log(F.lit(1.02))), "bucket": F.shiftrightunsigned(F.xxhash64("word"), 48)})
    steps = collected(words.groupBy("step").agg(F.count("*").alias("words"))).sort_values("step", ascending=False)  # a few hundred rows
    whole = steps["words"].cumsum() <= most
    lowest = int(steps[whole]["step"].min()) if whole.any() else 1 << 40
    if whole.all():
        return words.drop("step", "bucket")
    partial = int(steps[~whole]["step"].max())
    buckets = collected(words.filter(F.col("step") == partial).groupBy("bucket").agg(F.count("*").alias("words"))).sort_values("bucket")  # 65,536 rows at most
    fits = buckets[buckets["words"].cumsum() <= most - int(steps[whole]["words"].sum())]["bucket"]
    some = (F.col("step") == partial) & (F.col("bucket") <= (int(fits.max()) if len(fits) else -1))
    return words.filter((F.col("step") >= lowest) | some).drop("step", "bucket")


@dataclass
class Table:
    """Sorted hashes of known words, with their counts and the index of each among the clustered words (-1: none)."""

    hash: np.ndarray
    n: np.ndarray
    index: np.ndarray
    most: int  # clustered words at most; the symbol of another word is this plus its class
    group: np.ndarray | None = None  # the class of each

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hash):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return at, self.hash[at] == h


def frequent_table(counts: DataFrame) -> Table:
    """FREQUENT words at most come to the driver, as hashes and counts; the first CLUSTERED of them are clustered."""
    top = most_frequent(counts, FREQUENT)
    pdf = collected(per_batch(top.select("word", "n"), lambda b: [pa.record_batch([pa.array(whole_hash(b.column(0))), b.column(1)], ["hash", "n"])], "hash long, n long"))
    h, n = pdf["hash"].to_numpy(np.int64).view(U64), pdf["n"].to_numpy(np.int64)
    order = np.argsort(h)
    h, n = h[order], n[order]
    index = np.full(len(h), -1)
    lead = np.lexsort((h, -n))[:CLUSTERED]
    index[lead] = np.arange(len(lead))
    return Table(h, n, index, CLUSTERED)


def whole_hash(column: pa.Array) -> np.ndarray:
    words = Words(raw(column), "space")  # a word is one word of its own text
    return words.hash.view(np.int64)


def symbols(words: Words, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every word its clustered index, or table.most + shape; its place in the table; and whether it has one."""
    at, known = table.find(words.hash)
    clustered = known & (table.index[at] >= 0) if len(table.index) else known
    out = np.empty(len(words), np.int64)
    out[clustered] = table.index[at[clustered]]
    other = np.flatnonzero(~clustered)
    out[other] = table.most + shape(words, other)
    return out, at, known


def with_ends(words: Words, values: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of all words and one end for each text, in order; and what stands before each of them (a text starts with end)."""
    flat = np.insert(values, words.first[1:], end)
    return flat, np.concatenate([[end], flat[:-1]])


def bigram_counts(texts: DataFrame, table: Table) -> DataFrame:
    """(a, b, n): how often symbol b follows symbol a; there are (CLUSTERED + SHAPES + 1)^2 of them at most."""
    shared = texts.sparkSession.sparkContext.broadcast(table)
    size, end = table.most + END + 1, table.most + END

    def run(batches):
        for group in grouped_batches(batches, 0):
            words = Words(group, "space", lower=True)
            flat, before = with_ends(words, symbols(words, shared.value)[0], end)
            code, n = np.unique(before * size + flat, return_counts=True)
            yield pa.record_batch([pa.array(code // size), pa.array(code % size), pa.array(n)], ["a", "b", "n"])
        release()

    bounded_batches(texts.sparkSession)
    return texts.select("text").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


class Exchange:
    """Clustered words and their classes, with class bigram counts that follow every move."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, clustered: int, most: int = CLUSTERED):
        size = most + END + 1
        self.clustered = clustered
        self.classes = np.concatenate([np.arange(most) % CLASSES, np.arange(END + 1)])  # other symbols are most + their class
        self.after, self.before = self.sides(a, b, n, size), self.sides(b, a, n, size)
        same = (a == b) & (a < clustered)
        self.own = np.bincount(a[same], weights=n[same], minlength=size)
        self.m = np.bincount(self.classes[a] * ALL + self.classes[b], weights=n, minlength=ALL * ALL).reshape(ALL, ALL)
        self.x = xlogx(self.m)

    @staticmethod
    def sides(key: np.ndarray, other: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        return np.searchsorted(key[order], np.arange(size + 1)), other[order], n[order]

    def counts(self, w: int, side: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        starts, other, n = side
        at = slice(starts[w], starts[w + 1])
        return np.bincount(self.classes[other[at]], weights=n[at], minlength=ALL)

    def likelihood(self) -> float:
        return float(self.x.sum() - xlogx(self.m.sum(axis=1)).sum() - xlogx(self.m.sum(axis=0)).sum())

    def put(self, c: int, left: np.ndarray, right: np.ndarray, own: float) -> None:
        """Add (or, with negative counts, take away) a word of class c."""
        self.m[c] += left
        self.m[:, c] += right
        self.m[c, c] += own
        self.x[c], self.x[:, c] = xlogx(self.m[c]), xlogx(self.m[:, c])

    def move(self, w: int) -> bool:
        """Give a word the class that raises the likelihood most, its own on a tie. Whether it moved."""
        c, own = int(self.classes[w]), self.own[w]
        left, right = self.counts(w, self.after), self.counts(w, self.before)
        left[c] -= own
        right[c] -= own
        self.put(c, -left, -right, -own)
        m, x, k = self.m, self.x, CLASSES
        rows, columns = m.sum(axis=1) + right, m.sum(axis=0) + left  # wherever the word goes, its neighbours' own totals hold it
        l, r = np.flatnonzero(left), np.flatnonzero(right)
        gain = (xlogx(m[:k, l] + left[l]) - x[:k, l]).sum(axis=1) + (xlogx(m[r, :k] + right[r, None]) - x[r, :k]).sum(axis=0)
        corner, lc, rc = np.diagonal(m)[:k], left[:k], right[:k]
        gain += xlogx(corner + lc + rc + own) - xlogx(corner + lc) - xlogx(corner + rc) + xlogx(corner)
        gain -= xlogx(rows[:k] + left.sum() + own) - xlogx(rows[:k]) + xlogx(columns[:k] + right.sum() + own) - xlogx(columns[:k])
        best = int(np.argmax(gain))
        if gain[best] <= gain[c] + 1e-6:
            best = c
        self.put(best, left, right, own)
        self.classes[w] = best
        return best != c

    def sweeps(self, still: float = STILL) -> list[tuple[float, int]]:
        """Sweeps until few words move; the likelihood after each sweep, and how many words moved in it."""
        done = [(self.likelihood(), self.clustered)]
        while done[-1][1] > still * self.clustered:
            moved = sum(self.move(w) for w in range(self.clustered))
            done.append((self.likelihood(), moved))
        return done


def class_matrix(bigrams: DataFrame, names: DataFrame) -> np.ndarray:
    """Class bigram counts, ALL x ALL."""
    a, b = names.toDF("a", "ca"), names.toDF("b", "cb")
    got = collected(bigrams.join(F.broadcast(a), "a").join(F.broadcast(b), "b").groupBy("ca", "cb").agg(F.sum("n").alias("n")))
    out = np.zeros((ALL, ALL))
    out[got["ca"].to_numpy(np.int64), got["cb"].to_numpy(np.int64)] = got["n"].to_numpy()
    return out


def exchange(bigrams: DataFrame, clustered: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of every symbol, and the class bigram counts. One task holds the bigram counts, whose number is bounded; the name
    table has CLUSTERED + END + 1 rows, so it is broadcast."""
    spark, most = bigrams.sparkSession, CLUSTERED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1), b.column(2)) for b in batches]
        if parts:
            a = np.concatenate([np.repeat(key, lists.value_lengths().to_numpy(zero_copy_only=False)) for key, lists, _ in parts]).astype(np.int16)
            b = np.concatenate([lists.flatten().to_numpy(zero_copy_only=False) for _, lists, _ in parts]).astype(np.int16)
            n = np.concatenate([lists.flatten().to_numpy(zero_copy_only=False) for _, _, lists in parts]).astype(np.float64)
            work = Exchange(a, b, n, clustered, most)
            work.sweeps()
            yield pa.record_batch([pa.array(np.arange(len(work.classes))), pa.array(work.classes)], ["s", "c"])
        release()

    bounded_batches(spark)
    lists = bigrams.groupBy("a").agg(F.collect_list(F.struct(F.col("b").cast("int").alias("b"), "n")).alias("p")).select("a", F.col("p.b").alias("b"), F.col("p.n").alias("n"))
    found = collected(lists.repartition(1).mapInArrow(run, "s long, c long"))
    classes = np.concatenate([np.arange(most) % CLASSES, np.arange(END + 1)])
    classes[found["s"].to_numpy(np.int64)] = found["c"].to_numpy(np.int64)
    return classes, class_matrix(bigrams, spark.createDataFrame(pd.DataFrame({"s": np.arange(len(classes)), "c": classes})))


def contexts(texts: DataFrame, table: Table, classes: np.ndarray) -> DataFrame:
    """word, k, n: how often each context k precedes each word that is not clustered."""
    shared = texts.sparkSession.sparkContext.broadcast((table, classes))

    def run(batches):
        table, classes = shared.value
        for group in grouped_batches(batches, 0):
            words = Words(group, "space", lower=True)
            symbol = symbols(words, table)[0]
            _, before = with_ends(words, classes[symbol], END)
            other = np.flatnonzero(symbol >= table.most)
            k = before[other + words.text[other]]  # one end token stands behind each earlier text
            h = words.hash[other] * U64(ALL) + k.astype(U64)
            _, first, n = np.unique(h, return_index=True, return_counts=True)
            names = [w.decode("utf-8", "replace") for w in words.words(other[first])]
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(k[first].astype(np.int32)), pa.array(n)], ["word", "k", "n"])
        release()

    bounded_batches(texts.sparkSession)
    return texts.select("text").mapInArrow(run, "word string, k int, n long").groupBy("word", "k").agg(F.sum("n").alias("n"))


def classified(preceding: DataFrame, matrix: np.ndarray) -> DataFrame:
    """word, n, class, pairs (k, n) of every word that is not clustered: of the classes of the clustered words, as they are in
    matrix, the one to which the word's contexts add most likelihood; classes without a clustered word are left out. A word has ALL contexts at most."""
    m = matrix[:, :CLASSES]
    x, column = xlogx(m), m.sum(axis=0)

    def run(batch: pa.RecordBatch):
        lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
        pairs = batch.column(1).flatten()
        k, n = pairs.field(0).to_numpy(zero_copy_only=False), pairs.field(1).to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        total = np.add.reduceat(n, starts)
        best = np.empty(len(lengths), np.int64)
        for i in range(0, len(lengths), 4096):
            j = min(i + 4096, len(lengths))
            at = slice(starts[i], starts[j] if j < len(lengths) else len(n))
            gain = np.add.reduceat(xlogx(m[k[at]] + n[at, None]) - x[k[at]], starts[i:j] - starts[i], axis=0)
            gain -= xlogx(column + total[i:j, None]) - xlogx(column)
            gain[:, column == 0] = -np.inf  # a class of its own would suit every word
            best[i:j] = gain.argmax(axis=1)
        yield pa.record_batch([batch.column(0), pa.array(total.astype(np.int64)), pa.array(best), batch.column(1)], ["word", "n", "class", "pairs"])

    lists = preceding.groupBy("word").agg(F.collect_list(F.struct("k", "n")).alias("pairs"))
    return per_batch(lists, run, "word string, n long, class long, pairs array<struct<k:int,n:bigint>>")


@dataclass
class Model:
    table: Table
    classes: np.ndarray  # of every symbol, as a context
    transition: np.ndarray  # log10 [context, class]
    class_tokens: np.ndarray
    class_words: np.ndarray
    tokens: int
    vocabulary: int
    ends: int

    def emission(self, n, c):
        """log10 p(word | class) from the word's count and class."""
        return np.log10((n + DELTA) / (self.class_tokens[c] + DELTA * (self.class_words[c] + 1)))

    def base(self, n):
        return np.log10((n + 0.1) / (self.tokens + 0.1 * (self.vocabulary + 1)))


def fit(texts: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the stored counts and classes of all words that are not clustered. Null texts are empty: they have an end
    token only."""
    counts = stored(word_counts(texts), "words")
    table = frequent_table(counts)
    bigrams = stored(bigram_counts(texts, table), "bigrams")
    clustered = int((table.index >= 0).sum())
    classes, matrix = exchange(bigrams, clustered)
    others = stored(classified(contexts(texts, table, classes), matrix), "classes")
    total = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("word").isNull(), F.col("n")))).first()
    # targets: clustered words and the end as they are, other words by their class, and words never seen by the shape of those seen once
    target = matrix.copy()
    target[:, CLASSES:END] = 0
    pairs = others.select("class", "n", F.explode("pairs").alias("p"))
    for r in pairs.groupBy("class", "p.k").agg(F.sum("p.n").alias("n")).collect():  # ALL x CLASSES rows at most
        target[r["k"], r["class"]] += r["n"]
    once = others.filter("n = 1").join(counts.select("word", "shape"), "word")
    for r in once.groupBy("shape", F.get("pairs", F.lit(0)).k.alias("k")).count().collect():  # ALL x SHAPES rows at most
        target[r["k"], r["shape"]] += r["count"]
    words = np.bincount(classes[:clustered], minlength=ALL).astype(float)
    for r in others.groupBy("class").count().collect():
        words[r["class"]] += r["count"]
    column = target.sum(axis=0)
    words[CLASSES:END], words[END] = column[CLASSES:END], 1
    table.group = groups(others, table, classes)
    p = (column + 0.5) / (column.sum() + 0.5 * ALL)
    transition = np.log10((target + BACKOFF * p) / (target.sum(axis=1, keepdims=True) + BACKOFF))
    return Model(table, classes, transition, column, words, int(total[0] or 0), int(total[1]), int(total[2] or 0)), others


def groups(others: DataFrame, table: Table, classes: np.ndarray) -> np.ndarray:
    """The class of every word of the table; those of its words that are not clustered come to the driver, by hash."""
    out = np.where(table.index >= 0, classes[table.index], 0)
    shared = others.sparkSession.sparkContext.broadcast(table.hash)

    def known(batch: pa.RecordBatch):
        h = whole_hash(batch.column(0))
        some = np.flatnonzero(np.isin(h.view(U64), shared.value))
        yield pa.record_batch([pa.array(h[some]), batch.column(1).take(pa.array(some))], ["hash", "class"])

    least = int(table.n.min()) if len(table.n) else 0
    found = collected(per_batch(others.filter(F.col("n") >= least).select("word", "class"), known, "hash long, class long"))
    at, there = table.find(found["hash"].to_numpy(np.int64).view(U64))
    free = there & (table.index[at] < 0) if len(table.index) else there
    out[at[free]] = found["class"].to_numpy(np.int64)[free]
    return out


def score(documents: DataFrame, model: Model, others: DataFrame) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, base_score, score and perplexity (by token). Equal rows get equal scores."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        m = shared.value
        words = Words(raw(batch.column(1)), "space", lower=True)
        symbol, at, known = symbols(words, m.table)
        place = np.arange(len(words)) + words.text  # among all tokens, with one end token behind each earlier text
        _, before = with_ends(words, m.classes[symbol], END)
        by_text = lambda x, some: np.bincount(words.text[some], weights=x, minlength=batch.num_rows)
        n, group = (m.table.n[at[known]], m.table.group[at[known]]) if len(m.table.n) else (np.empty(0), np.empty(0, np.int64))
        stop = words.first[1:] + np.arange(len(words.counts))
        total = by_text(m.transition[before[place[known]], group] + m.emission(n, group), known) + m.transition[before[stop], END] + m.emission(m.ends, END)
        base = by_text(m.base(n), known) + m.base(m.ends)
        # words outside the table, once for each text and context
        rare = np.flatnonzero(~known)
        key, k = words.text[rare].astype(np.int64), before[place[rare]]
        order = np.lexsort((k, words.hash[rare], key))
        rare, key, k = rare[order], key[order], k[order]
        h = words.hash[rare]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (key[1:] != key[:-1]) | (k[1:] != k[:-1])]) if len(rare) else np.empty(0, bool)
        lead = np.flatnonzero(new)
        times = np.diff(np.concatenate([lead, [len(rare)]]))
        values = pa.StructArray.from_arrays(
            [pa.array([w.decode("utf-8", "replace") for w in words.words(rare[lead])], pa.string()), pa.array(times), pa.array(k[lead]), pa.array(m.classes[symbol[rare[lead]]])],
            ["word", "times", "k", "shape"])
        number = np.bincount(key[lead], minlength=batch.num_rows)
        rows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(number)]).astype(np.int32)), values)
        seen = by_text(np.ones(int(known.sum())), known).astype(np.int64) + (m.ends > 0)
        yield pa.record_batch(
            [batch.column(0), pa.array(words.counts + 1), pa.array(seen), pa.array(base), pa.array(total), rows], ["doc_id", "n_tokens", "seen", "base", "total", "rare"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = per_batch(documents.select("doc_id", "text"), run, (
        f"doc_id {kind}, n_tokens long, seen long, base double, total double, rare array<struct<word:string,times:long,k:long,shape:long>>"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(others.select("word", F.col("n").alias("c"), "class"), "word", "left")
    c, group = F.coalesce("c", F.lit(0)), F.coalesce("class", "shape")
    number = lambda values, i: F.element_at(F.split(F.lit(",".join(map(repr, map(float, values)))), ",").cast("array<double>"), i.cast("int") + 1)
    log_size = number(np.log10(model.class_tokens + DELTA * (model.class_words + 1)), group)
    extra = rare.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("times"))).alias("known"),
        F.sum(F.col("times") * (F.log10(c + 0.1) - float(np.log10(model.tokens + 0.1 * (model.vocabulary + 1))))).alias("base_more"),
        F.sum(F.col("times") * (F.log10(c + DELTA) - log_size + number(model.transition.ravel(), F.col("k") * ALL + group))).alias("more"))
    joined = rows.drop("rare").join(extra, "row", "left")
    zero = F.lit(0.0)
    out = joined.select(
        "doc_id", "n_tokens", (F.col("seen") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_more", zero)).alias("base_score"), (F.col("total") + F.coalesce("more", zero)).alias("score"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def held_out_scores(documents: DataFrame) -> DataFrame:
    """Scores of all rows by a model of those whose id's remainder by 10 is not 0; the others are held out."""
    held = remainder("doc_id", 10) == 0
    model, others = fit(documents.filter(~held).select("text"))
    return score(documents, model, others).withColumn("held_out", held)
