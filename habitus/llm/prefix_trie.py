"""The trie of all conversation prefixes, from whole sequences that are collapsed first.

Identical conversations become one weighted sequence with the list of those that end there. Each sequence is expanded to
its prefixes once, so a node's figures are sums of weights over sequences:

* members are the weights of the sequences through the node; its name is the smallest conversation among them;
* leaves are sequences that are no proper prefix of another one, found by an anti-join;
* a node belongs to the sequence with its name. The nodes that one sequence owns are its deepest ones, from some depth on,
  so what is counted once per node of a subtree (text saved, children) is a sum over sequences as well.

A turn's place in its conversation comes from a range partitioning by (conversation, turn) and running totals over the parts,
so one conversation with a third of all turns is spread over many tasks. A prefix is known by the exclusive or of 120 bits of
SHA-256 of each of its (position, turn), which adds up over parts in any order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from habitus.llm.text import bounded_batches, stored

FAMILY, MOST = 5, 9  # conversations that share an opening, and the bound of its length: crc32(conv_id) modulo MOST turns
PART = ["conv", "part"]
ENDS = 12  # conversations of one sequence travel as strings of those with equal ids without their last 12 bits


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """conv, part, pos (from 1), mark (digest of role and text), bytes (of the text) of every turn."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    mark = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn", mark.alias("mark"), F.octet_length(text).cast("long").alias("bytes"))
    placed = stored(rows.repartitionByRange("conv", "turn", "mark").withColumn("part", F.spark_partition_id()), "turns")
    local = placed.withColumn("rn", F.row_number().over(Window.partitionBy(*PART).orderBy(F.asc_nulls_first("turn"), "mark")))
    before = carried(placed.groupBy(*PART).agg(F.count("*").alias("n")), before=F.sum("n"))
    return stored(local.join(before.select(*PART, "before"), PART).select(*PART, (F.coalesce("before", F.lit(0)) + F.col("rn")).alias("pos"), "mark", "bytes"), "turns")


def carried(totals: DataFrame, **sums: Column) -> DataFrame:
    """For each part of a conversation the sums over all parts before it; null for the first."""
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumns({name: total.over(earlier) for name, total in sums.items()})


def keyed(position: Column, mark: Column) -> tuple[Column, Column]:
    """Two numbers of 60 bits for a turn at a position."""
    digest = F.sha2(F.concat_ws(":", position.cast("string"), mark).cast("binary"), 256)
    return tuple(F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 16))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): conv, part, q (position), ha, hb, bytes of the turns of every rebuilt conversation, where part -1
    is the opening taken over from the family's first conversation; and all conv."""
    sizes = turns.groupBy(*PART).agg(F.lit(1).alias("one")).drop("one")
    convs = sizes.select("conv").distinct()
    head = turns.filter((F.col("pos") < MOST) & (F.col("conv") % FAMILY == 0)).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("pos", "mark", "bytes"))).alias("head"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % MOST
    taken = F.coalesce(F.slice(F.col("head"), F.lit(1), F.col("h")), F.array().cast("array<struct<pos:bigint,mark:string,bytes:bigint>>"))
    openings = convs.select("conv", h.cast("int").alias("h"), (F.col("conv") - F.col("conv") % FAMILY).alias("first")).join(
        head.withColumnRenamed("conv", "first"), "first", "left").select("conv", "h", taken.alias("head"))
    info = sizes.join(openings.select("conv", "h", F.size("head").alias("given")), "conv")
    own = turns.join(info, PART).filter(F.col("pos") > F.col("h")).select(*PART, (F.col("given") + F.col("pos") - F.col("h")).cast("long").alias("q"), "mark", "bytes")
    given = openings.select("conv", F.explode("head").alias("t")).select("conv", F.lit(-1).alias("part"), F.col("t.pos").cast("long").alias("q"), "t.mark", "t.bytes")
    both = own.union(given)
    ha, hb = keyed(F.col("q"), F.col("mark"))
    return stored(both.select(*PART, "q", ha.alias("ha"), hb.alias("hb"), "bytes"), "rebuilt"), stored(convs, "convs")


def collapsed(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, sequences, ends): sums per part with those of earlier parts; depth, ka, kb, conv (the smallest), weight and total
    bytes of each distinct sequence; and the hash of the conversations that end at it."""
    totals = turns.groupBy(*PART).agg(F.count("*").alias("n"), F.bit_xor("ha").alias("xa"), F.bit_xor("hb").alias("xb"), F.sum("bytes").alias("size"))
    totals = stored(carried(totals, ca=F.bit_xor("xa"), cb=F.bit_xor("xb"), csize=F.sum("size")), "totals")
    whole = totals.groupBy("conv").agg(F.sum("n").alias("n"), F.bit_xor("xa").alias("xa"), F.bit_xor("xb").alias("xb"), F.sum("size").alias("size"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    each = convs.join(whole, "conv", "left").select("conv", zero("n").alias("depth"), zero("xa").alias("ka"), zero("xb").alias("kb"), zero("size").alias("total"))
    each = stored(each, "sequences")
    key = ["depth", "ka", "kb"]
    sequences = stored(each.groupBy(*key).agg(F.min("conv").alias("conv"), F.count("*").alias("weight"), F.max("total").alias("total")), "sequences")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    chunks = each.groupBy(*key, F.shiftright("conv", ENDS).alias("chunk")).agg(ids.alias("ids"))
    bounded_batches(turns.sparkSession)
    ends = chunks.repartition(*key).sortWithinPartitions(*key, "chunk").mapInArrow(hashed_lists, "depth long, ka long, kb long, ends_sha256 string")
    return totals, sequences, ends


def hashed_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the strings of equal keys, joined by commas, in the order they come; one state at a time is held."""
    key, state = None, None
    names = ["depth", "ka", "kb", "ends_sha256"]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(names, (*k, s.hexdigest()))) for k, s in done], pa.schema([*((n, pa.int64()) for n in names[:3]), (names[3], pa.string())]))

    for batch in batches:
        done = []
        for *k, _, ids in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if k != key:
                if state:
                    done.append((key, state))
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield row()
    if state:
        done = [(key, state)]
        yield row()


def prefixes(turns: DataFrame, totals: DataFrame, sequences: DataFrame) -> DataFrame:
    """conv, q, ka, kb (the prefix), pa, pb (the prefix before it), cum (bytes so far), bytes, depth (of the sequence), total,
    weight for each prefix of each sequence, the empty one included."""
    carry = totals.join(sequences.select("conv", "depth", "total", "weight"), "conv").select(*PART, "ca", "cb", "csize", "depth", "total", "weight")
    sofar = Window.partitionBy(*PART).orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    rows = turns.join(carry, PART).withColumns({
        "ka": F.bit_xor("ha").over(sofar).bitwiseXOR(zero("ca")), "kb": F.bit_xor("hb").over(sofar).bitwiseXOR(zero("cb")), "cum": F.sum("bytes").over(sofar) + zero("csize")})
    names = ["conv", "q", "ka", "kb", "pa", "pb", "cum", "bytes", "depth", "total", "weight"]
    none, nil = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = sequences.select("conv", none.alias("q"), none.alias("ka"), none.alias("kb"), nil.alias("pa"), nil.alias("pb"), none.alias("cum"), none.alias("bytes"), "depth", "total", "weight")
    below = rows.withColumns({"pa": F.col("ka").bitwiseXOR(F.col("ha")), "pb": F.col("kb").bitwiseXOR(F.col("hb"))})
    return stored(below.select(*names).union(root.select(*names)), "prefixes")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn (null first), those of equal turn by the SHA-256 of their role and text; repeated rows are turns
    of their own. Null roles and texts are empty; rows with a null conv_id take no part. The remainder by FAMILY is SQL's,
    with the sign of the conv_id. An empty table has no nodes. Other columns are not read.
    """
    turns, convs = rebuilt(turns_in_order(conversations))
    totals, sequences, ends = collapsed(turns, convs)
    rows = prefixes(turns, totals, sequences)
    key = ["q", "ka", "kb"]
    nodes = stored(rows.groupBy(*key).agg(
        F.min("conv").alias("conv"), F.max(F.col("q") < F.col("depth")).alias("deeper"), F.max("bytes").alias("bytes"), F.max("pa").alias("pa"), F.max("pb").alias("pb")), "nodes")
    owned = nodes.groupBy("conv").agg(F.min_by(F.struct("q", "pa", "pb"), "q").alias("top"), F.sum("bytes").alias("own")).select(
        "conv", F.col("top.q").alias("since"), F.col("top.pa").alias("pa"), F.col("top.pb").alias("pb"), "own")
    parents = nodes.select((F.col("q") + 1).alias("since"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv").alias("up"))
    owned = owned.join(parents, ["since", "pa", "pb"], "left").select("conv", "since", "up", "own")
    inner = nodes.filter("deeper").select(F.col("q").alias("depth"), "ka", "kb")
    leaves = sequences.join(inner, ["depth", "ka", "kb"], "left_anti").select("conv", F.lit(1).cast("long").alias("leaf"))
    about = stored(sequences.select("conv", "depth").join(owned, "conv", "left").join(leaves, "conv", "left").select(
        "conv", F.coalesce("since", F.col("depth") + 1).alias("since"), "up", F.coalesce("own", F.lit(0)).cast("long").alias("own"), F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf")), "owners")
    q, since, left = F.col("q"), F.col("since"), F.col("total") - F.col("cum") + F.col("bytes")
    figures = rows.join(about, "conv").groupBy(*key).agg(
        F.min("conv").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
        F.sum(((since <= q + 1) & (q + 1 <= F.col("depth"))).cast("long")).alias("n_children"),
        (F.sum(F.col("weight") * left) - F.sum(F.when(q >= since, left).otherwise(F.col("own")))).alias("saved_tokens"),
        F.max(F.when(q > since, F.col("conv")).when(q == since, F.col("up"))).alias("parent_conv_id"))
    ended = figures.join(ends.withColumnRenamed("depth", "q"), key, "left")
    return ended.select("conv_id", F.col("q").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
