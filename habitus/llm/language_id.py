"""Language identification by words first, and by ever shorter character n-grams for words that are not known.

Every language has a table of its frequent words and of character n-grams. A known word adds its log frequency in each
language. An unknown word is cut into n-grams of MOST characters, its edges marked; if none of them was seen, shorter ones
are taken. The language with the highest total over all words, its share of all learned words included, wins; of equal ones,
the first in order of its name.

The model is fitted on a bounded sample: of the labelled rows, about SAMPLE of each language, those with the lowest hashes. It holds
WORDS words a language and 2^BUCKET_BITS hashed n-grams a length, so its size is bounded too. Predictions read all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from habitus.llm.text import U64, Words, collected, mix, per_batch, remainder, stored

SAMPLE = 4000  # labelled rows a language
WORDS = 50_000  # known words a language
MOST = 4  # characters of the longest n-grams
BUCKET_BITS = 16
EDGE = ord("_")
TEMPER = 20  # words whose evidence a score stands for, at most


def lowered(column: pa.Array) -> list[bytes]:
    return [(t or "").lower().encode() for t in column.to_pylist()]


def ngrams(words: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """From the longest on, each length with the buckets of all n-grams of the words, and the word of each."""
    points = np.frombuffer(("_" + "_".join(w.decode("utf-8", "replace") for w in words) + "_").encode("utf-32-le"), np.uint32).astype(U64)
    edge = points == U64(EDGE)
    owner = (np.cumsum(edge) - 1).astype(np.int32)  # an edge belongs to the word behind it
    for n in range(MOST, 0, -1):
        total = len(points) - n + 1
        if total <= 0:
            continue
        h, ok = np.zeros(total, U64) + U64(n), np.ones(total, bool)
        for j in range(n):
            h = h * U64(0x9E3779B97F4A7C15) + points[j : j + total] + U64(1)
            if n == 1 or 0 < j < n - 1:
                ok &= ~edge[j : j + total]
        if n == 2:
            ok &= ~(edge[:total] & edge[1:])
        at = np.flatnonzero(ok)
        yield n, (mix(h[at]) >> U64(64 - BUCKET_BITS)).astype(np.int32), owner[at]


def counts(rows: DataFrame) -> DataFrame:
    """(lang, length, code, n) from columns lang and text: length 0 counts words by hash, others n-grams by bucket."""

    def run(batch: pa.RecordBatch):
        langs, index = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
        words = Words(lowered(batch.column(1)), "letter")
        out: list[list] = [[], [], [], []]
        for i, lang in enumerate(langs):
            at = np.flatnonzero(index[words.text] == i)
            if not len(at):
                continue
            h, first, n = np.unique(words.hash[at], return_index=True, return_counts=True)
            found = [(0, h.view(np.int64), n)]
            for length, bucket, owner in ngrams(words.words(at[first])):
                total = np.bincount(bucket, weights=n[owner])
                code = np.flatnonzero(total)
                found.append((length, code, total[code].astype(np.int64)))
            for length, code, times in found:
                out[0] += [lang] * len(code)
                out[1].append(np.full(len(code), length))
                out[2].append(code)
                out[3].append(times)
        cat = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64))
        yield pa.record_batch([pa.array(out[0], pa.string()), cat(out[1]), cat(out[2]), cat(out[3])], ["lang", "length", "code", "n"])

    return per_batch(rows.select("lang", "text"), run, "lang string, length long, code long, n long").groupBy("lang", "length", "code").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    langs: list[str]
    words: np.ndarray  # sorted hashes
    word_scores: np.ndarray  # [word, language]
    seen: np.ndarray  # [length - 1, bucket]
    gram_scores: np.ndarray  # [length - 1, bucket, language]
    prior: np.ndarray

    def totals(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The sum of scores [text, language] and the number of words of each text."""
        words = Words(texts, "letter")
        out = np.zeros((len(texts), len(self.langs)))
        h = words.hash
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1) if len(self.words) else np.zeros(len(h), np.int64)
        known = self.words[at] == h if len(self.words) else np.zeros(len(h), bool)
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(words.text[known], weights=self.word_scores[at[known], k], minlength=len(texts))
        new = np.flatnonzero(~known)
        if len(new):
            _, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            scores = self.unknown(words.words(new[first]))
            for k in range(len(self.langs)):
                out[:, k] += np.bincount(words.text[new], weights=scores[back, k], minlength=len(texts))
        return out, words.counts

    def unknown(self, words: list[bytes]) -> np.ndarray:
        """Scores of unknown words: the mean of their longest n-grams that were seen anywhere."""
        out, left = np.zeros((len(words), len(self.langs))), np.ones(len(words), bool)
        for n, bucket, owner in ngrams(words):
            use = left[owner] & self.seen[n - 1][bucket]
            bucket, owner = bucket[use], owner[use]
            number = np.bincount(owner, minlength=len(words))
            got = number > 0
            for k in range(len(self.langs)):
                total = np.bincount(owner, weights=self.gram_scores[n - 1][bucket, k], minlength=len(words))
                out[got, k] = total[got] / number[got]
            left &= ~got
            if not left.any():
                break
        return out


def sample(rows: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Of each language the rows whose hash is low enough that about `most` are left. No text moves for it."""
    labelled = rows.filter("text IS NOT NULL AND lang IS NOT NULL")
    share = labelled.groupBy("lang").agg((F.lit(float(most)) / F.count("*")).alias("share"))
    key = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(1 << 30)) / (1 << 30)
    return labelled.join(F.broadcast(share), "lang").filter(key < F.col("share")).select("lang", "text")  # a row a language, as in the model


def fit(rows: DataFrame, most: int = SAMPLE, words: int = WORDS) -> Model:
    """Fit from rows with doc_id, lang and text; rows without a language or text teach nothing."""
    table = stored(counts(sample(rows, most)), "language")
    place = F.row_number().over(Window.partitionBy("lang", "length").orderBy(F.desc("n"), "code"))
    pdf = collected(table.withColumn("place", place).filter((F.col("length") > 0) | (F.col("place") <= words)).drop("place"))
    langs = sorted(pdf["lang"].unique().tolist())
    pdf["k"] = pdf["lang"].map({x: i for i, x in enumerate(langs)}).astype(np.int64)
    some = pdf[pdf["length"] == 0]
    known, row = np.unique(some["code"].to_numpy(np.int64).view(U64), return_inverse=True)
    tally = np.zeros((len(known), len(langs)))
    tally[row, some["k"].to_numpy()] = some["n"].to_numpy()
    grams = np.zeros((MOST, 1 << BUCKET_BITS, len(langs)))
    rest = pdf[pdf["length"] > 0]
    grams[rest["length"].to_numpy(np.int64) - 1, rest["code"].to_numpy(np.int64), rest["k"].to_numpy()] = rest["n"].to_numpy()
    share = lambda x, axis: np.log((x + 0.5) / (x.sum(axis=axis, keepdims=True) + 0.5 * max(1, x.shape[axis])))
    total = tally.sum(axis=0)
    return Model(langs, known, share(tally, 0).astype(np.float32), grams.sum(axis=2) > 0, share(grams, 1).astype(np.float32), np.log((total + 1) / (total.sum() + len(langs))))


def predict(documents: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add the language and its score (0 to 1), under two names, to the columns in keep.

    The score is the language's share of the odds, tempered to the evidence of TEMPER words so that long texts do not all get 1;
    it has no say in the choice. Null texts, and texts without a letter, are `und` with score 0, as is everything if no language was learned.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        m, column = shared.value, batch.column(len(keep))
        texts = lowered(column)
        letters = np.array([any(map(str.isalpha, t)) if t else False for t in column.to_pylist()], bool)
        if not m.langs:
            best, score = np.full(len(texts), None), np.zeros(len(texts))
        else:
            total, n = m.totals(texts)
            at = np.argmax(total + m.prior, axis=1)
            odds = total * (np.minimum(n, TEMPER) / np.maximum(n, 1))[:, None] + m.prior
            odds = np.exp(odds - odds.max(axis=1, keepdims=True))
            best, score = np.array(m.langs, object)[at], odds[np.arange(len(at)), at] / odds.sum(axis=1)
        ok = letters & (best != None)  # noqa: E711
        pred = pa.array([b if o else "und" for b, o in zip(best.tolist(), ok.tolist())], pa.string())
        yield pa.record_batch([*batch.columns[: len(keep)], pred, pa.array(np.where(ok, score, 0.0))], [*keep, *names])

    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    return per_batch(documents.select(*keep, text), run, f"{kinds}, `{names[0]}` string, `{names[1]}` double")


def held_out_predictions(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; learned from rows whose id's remainder by 4 is not 2."""
    held = remainder("doc_id", 4) == 2
    model = fit(documents.filter(~held))
    return predict(documents, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
