"""Hard negatives for anchor vectors, with score bounds carried along spanning trees of the anchors.

Anchors are dealt to blocks, and a minimum spanning tree joins the anchors of each block. All candidates are scored at the
root. From there a candidate's score at a child lies within (length of the edge) x (norm of the candidate) of its score at
the parent, so a child rescores only candidates whose interval can still matter: for positives, those that can be among the
best; for negatives, those whose interval overlaps a window and that the best already certain ones don't beat. Where no
vectors are close to each other the intervals are wide and all candidates of a block are rescored; results are exact either way.

Work is done for pairs of a block of at most about BLOCK anchors and a chunk of at most about CHUNK candidates, dealt by a
hash of the id, so memory is bounded and a label that holds a third of all rows is many chunks. Only the best of each pair
leave it and are merged by rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from habitus.llm.text import bounded_batches, stored

BLOCK, CHUNK = 1024, 8192
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # a negative's score lies between these hundredths of the positive's
SCALE, LARGEST = 256, 1 << 24  # components become floor(SCALE * x), at most LARGEST from zero
DENSE = 0.25  # share of candidates from which all are rescored at once


def quantised(embedding: Column) -> Column:
    """floor(SCALE * x) of each component as int; null if the vector or a component is null or not finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(embedding, lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, F.lit(-LARGEST)), F.lit(LARGEST))).cast("int"))
    return F.when(~bad, scaled)


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, q of the rows that take part; of rows with one vec_id the first by label, then by components."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), quantised(F.col("embedding")).alias("q"))
    best = rows.dropna().groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("v"))
    return best.select("vec_id", "v.label", "v.q")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of ints as rows; a shorter list is filled up with zeros."""
    values = column.combine_chunks()
    values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
    flat, length = values.flatten().to_numpy(zero_copy_only=False), values.value_lengths().to_numpy(zero_copy_only=False)
    width = int(length.max(initial=0))
    if (length == width).all():
        return flat.reshape(len(length), width)
    out = np.zeros((len(length), width), flat.dtype)
    out[np.arange(width) < length[:, None]] = flat
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1], 1)
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))


def norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", m.astype(np.float64), m.astype(np.float64)))


def spanning_tree(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge) of a minimum spanning tree over the rows: row order[i] hangs on row parent[i] (itself for the
    root), edge[i] away; parents come first."""
    m = m.astype(np.float64)
    n, square = len(m), np.einsum("ij,ij->i", m, m)
    order, parent, edge = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    near, link = np.full(n, np.inf), np.zeros(n, np.int64)
    left = np.ones(n, bool)
    at = 0
    for i in range(n):
        order[i], parent[i], edge[i] = at, link[at] if i else at, near[at] if i else 0.0
        left[at] = False
        far = np.maximum(square + square[at] - 2 * (m @ m[at]), 0)
        closer = left & (far < near)
        near[closer], link[closer] = far[closer], at
        near[at] = np.inf
        at = int(np.argmin(np.where(left, near, np.inf)))
    return order, parent, np.sqrt(edge)


def with_tree(table: pa.Table) -> pa.Table:
    """For each anchor of a block its place in tree order, the place of its parent and the length of the edge to it."""
    order, parent, edge = spanning_tree(matrix(table["q"]))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return pa.table({"vec_id": table["vec_id"].take(pa.array(order)), "place": np.arange(len(order)), "parent": place[parent], "edge": edge})


class Scores:
    """Scores of a chunk of candidates at one anchor after the other, exact where asked for, else bounded."""

    def __init__(self, anchors: np.ndarray, candidates: np.ndarray):
        self.a, self.c = same_width(anchors, candidates)
        self.norm = norms(self.c)
        top = float(norms(self.a).max(initial=0) * self.norm.max(initial=0))  # no sum of products exceeds it on the way
        self.kind = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64
        self.a, self.c = self.a.astype(self.kind), self.c.astype(self.kind)
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def bounds(self, parent: int | None, edge: float) -> tuple[np.ndarray, np.ndarray]:
        """(middle, radius) at a child from those at its parent; the root knows nothing."""
        if parent is None:
            return np.zeros(len(self.c)), np.full(len(self.c), np.inf)
        middle, radius = self.held[parent]
        return middle.copy(), radius + edge * self.norm * (1 + 1e-9) + 1e-9 * np.abs(middle) + 1e-3

    def settle(self, at: int, middle: np.ndarray, radius: np.ndarray, wanted: np.ndarray, keep: bool) -> np.ndarray:
        """Exact scores of the wanted candidates, as int64; others are 0."""
        out = np.zeros(len(self.c), np.int64)
        if np.count_nonzero(wanted) > DENSE * len(wanted):
            exact = self.c @ self.a[at]
            out[:] = exact
            middle[:], radius[:] = exact, 0
        else:
            some = np.flatnonzero(wanted)
            exact = self.c[some] @ self.a[at]
            out[some] = exact
            middle[some], radius[some] = exact, 0
        if keep:
            self.held[at] = middle, radius
        return out


def largest(scores: np.ndarray, ids: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """Of the places in among, those of the k highest scores, ties by smaller id, in this order."""
    if len(among) > k:
        among = among[scores[among] >= np.partition(scores[among], -k)[-k]]
    return among[np.lexsort((ids[among], -scores[among]))[:k]]


def kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, -k)[-k]) if len(values) >= k else -np.inf


def walk(anchors: pa.Table, candidates: pa.Table, visit) -> None:
    """visit(i, scores, middle, radius, keep) for each anchor in tree order; anchors nobody hangs on are not kept."""
    scores = Scores(matrix(anchors["q"]), matrix(candidates["q"]))
    parent, edge = anchors["parent"].to_numpy(), anchors["edge"].to_numpy()
    last = np.full(len(parent), -1)
    last[parent[1:]] = np.arange(1, len(parent))
    for i in range(len(parent)):
        visit(i, scores, *scores.bounds(int(parent[i]) if i else None, float(edge[i])), last[i] > i)
        if i and last[parent[i]] == i:
            del scores.held[int(parent[i])]


def in_order(anchors: pa.Table) -> pa.Table:
    return anchors.sort_by("place")


def positives_of(k: int):
    """Best k other candidates of each anchor of a block; all share the anchors' label."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            left = in_order(left)
            own, ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()

            def visit(i, scores, middle, radius, keep):
                other = ids != own[i]
                wanted = other & (middle + radius >= kth((middle - radius)[other], k)) if np.isfinite(radius).all() else np.ones(len(ids), bool)
                exact = scores.settle(i, middle, radius, wanted, keep)
                for j in largest(exact, ids, np.flatnonzero(wanted & other), k):
                    found.append((own[i], ids[j], exact[j]))

            walk(left, right, visit)
        return rows(found, ("anchor_id", "positive_id", "positive_score"))

    return run


def negatives_of(k: int, low: int, high: int):
    """For each anchor and positive the best k candidates of other labels whose score lies in the positive's window."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            left = in_order(left)
            own, labels, positives = left["vec_id"].to_numpy(), left["label"].to_numpy(), left["positives"].to_pylist()
            ids, other_labels = right["vec_id"].to_numpy(), right["label"].to_numpy()

            def visit(i, scores, middle, radius, keep):
                other = other_labels != labels[i]
                windows = [(p["positive_id"], p["positive_score"], -(-low * p["positive_score"] // 100), high * p["positive_score"] // 100) for p in positives[i]]
                windows = [w for w in windows if w[2] <= w[3]]
                wanted = np.ones(len(ids), bool)
                if np.isfinite(radius).all():
                    least, most, wanted = middle - radius, middle + radius, np.zeros(len(ids), bool)
                    for _, _, a, b in windows:
                        certain = other & (least >= a) & (most <= b)
                        wanted |= other & (most >= max(a, kth(least[certain], k))) & (least <= b)
                exact = scores.settle(i, middle, radius, wanted, keep)
                wanted &= other
                for positive, score, a, b in windows:
                    for j in largest(exact, ids, np.flatnonzero(wanted & (exact >= a) & (exact <= b)), k):
                        found.append((own[i], positive, score, ids[j], exact[j]))

            walk(left, right, visit)
        return rows(found, ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"))

    return run


def rows(found: list[tuple], names: tuple[str, ...]) -> pa.Table:
    columns = list(zip(*found)) or [[]] * len(names)
    return pa.table({n: pa.array(np.array(c, np.int64)) for n, c in zip(names, columns)})


def schema(*names: str) -> str:
    return ", ".join(f"{n} long" for n in names)


def dealt(df: DataFrame, part: str, most: int, kind: str = "kind") -> tuple[DataFrame, DataFrame]:
    """df with a part number by the hash of vec_id, of about most rows each within its kind, and the number of parts of each kind."""
    parts = df.groupBy(kind).agg(F.ceil(F.count("*") / most).cast("int").alias(f"{part}s"))
    return df.join(parts, kind).withColumn(part, F.pmod(F.xxhash64("vec_id"), F.col(f"{part}s")).cast("int")).drop(f"{part}s"), parts


def blocks(anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Anchors with their block and its tree, stored, and the number of blocks of each kind."""
    placed, counts = dealt(anchors, "block", BLOCK)
    bounded_batches(anchors.sparkSession)
    trees = placed.select("kind", "block", "vec_id", "q").groupBy("kind", "block").applyInArrow(with_tree, "vec_id long, place long, parent long, edge double")
    return stored(placed.join(trees, "vec_id"), "anchors"), counts


def over_pairs(anchors: DataFrame, candidates: DataFrame, fn, out: str) -> DataFrame:
    """fn of every block of anchors and chunk of candidates of the same kind."""
    placed, n_blocks = blocks(anchors)
    chunked, n_chunks = dealt(candidates, "chunk", CHUNK)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.join(n_chunks, "kind").withColumn("chunk", each("chunks")).drop("chunks")
    right = chunked.join(n_blocks, "kind").withColumn("block", each("blocks")).drop("blocks")
    key = ["kind", "block", "chunk"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(fn, out)


def ranked(df: DataFrame, by: list[str], score: str, name: str, most: int) -> DataFrame:
    """df with rank among the rows of equal by, highest score first, ties by smaller name; the first most of each."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), name)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the anchors among rows, as vectors() gives them.

    Rows with a null id, label, vector or component, or a component that is not finite, take no part; of rows that repeat a
    vec_id one counts (vectors). Scores are inner products of whole numbers; a vector shorter than the other is filled up
    with zeros, and an empty one scores 0. Equal scores are ordered by vec_id. A window of a negative positive_score is
    empty. Empty tables, or anchors without a positive or a negative, give no rows. Other columns are not read.
    """
    rows = stored(rows.select("vec_id", "label", "q", F.col("label").alias("kind"), F.lit(0).alias("whole")), "vectors")
    anchors = rows.filter(is_anchor)
    same = over_pairs(anchors.drop("whole"), rows.drop("whole"), positives_of(positives), schema("anchor_id", "positive_id", "positive_score"))
    best = ranked(same, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank")
    each = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    every = lambda df: df.withColumn("kind", F.col("whole")).drop("whole")
    found = over_pairs(every(anchors.join(each, "vec_id")), every(rows), negatives_of(negatives, low, high),
                       schema("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"))
    return ranked(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
