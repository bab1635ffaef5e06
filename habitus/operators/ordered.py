"""Order statistics that stay distributed however large one group is: prefix sums, quantiles and dense numbering.

A window over a whole group runs in one task, and so does the percentile aggregate. Here every ordered computation
is split by a monotone bin of the ordering value: per-bin totals are small, a window over them gives each bin's
starting offset, and only rows of the same bin are ever sorted together.

Where all rows are ordered together the bins are ranges between split points, which are approximate percentiles of the
rows themselves: every range holds about as many rows, however the values lie. The rows are stored first, so that split
points, totals and ranks come from the same ones. Groups of their own keys are ordered whole while they are small, so their rows move
once; only groups of over 100,000 rows take bins, of a logarithmic scale, which need no look at the data before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from habitus.session import materialize

PARTS = 1024  # ranges of ungrouped data
COARSE = 8
WHOLE, SHARE = 100_000, 16_384  # rows of a group that one task orders, or one in SHARE of all rows if that is more


def monotone_bin(x: Column | str, resolution: int = COARSE) -> Column:
    """A whole number that never falls as x grows: signed log scale, `resolution` bins per doubling of 1 + |x|."""
    v = (F.col(x) if isinstance(x, str) else x).cast("double")
    return F.floor(F.signum(v) * F.log2(F.lit(1.0) + F.abs(v)) * F.lit(float(resolution)))


def split_points(df: DataFrame, x: str, parts: int = PARTS) -> list[float]:
    """At most parts - 1 values that cut the rows of df into ranges of about equal size, from one pass in bounded memory.

    They steer only where rows are ranked: any list of values gives the same results.
    """
    at = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    found = df.where(F.col(x).isNotNull()).agg(F.percentile_approx(F.col(x).cast("double"), at, 20 * parts)).first()[0]
    return sorted(set(found or []))


def range_bin(x: Column | str, points: list[float]) -> Column:
    """How many of the sorted points are at or below x, by binary search."""
    v = (F.col(x) if isinstance(x, str) else x).cast("double")
    if not points:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(repr, points))), ",").cast("array<double>")  # folded once into a constant
    strides = F.array(*[F.lit(1 << i) for i in reversed(range(len(points).bit_length()))])
    reached = lambda n: F.coalesce(F.get(table, n - 1) <= v, F.lit(False))
    return F.aggregate(strides, F.lit(0), lambda n, stride: F.when(reached(n + stride), n + stride).otherwise(n))


def binned(df: DataFrame, x: str, keys: tuple[str, ...], label: str) -> DataFrame:
    """df with `_bin`: by split points of the stored rows if all are ordered together, else by a logarithmic scale."""
    if keys:
        return df.withColumn("_bin", monotone_bin(x))
    return split(df, x, label)


def split(df: DataFrame, x: str, label: str) -> DataFrame:
    """df, stored, with `_bin` by split points over all rows; no bin of any group holds much more than 1 / PARTS of all rows."""
    kept = materialize(df, label)
    return kept.withColumn("_bin", range_bin(x, split_points(kept, x)))


def by_size(
    rows: DataFrame, keys: tuple[str, ...], small: Callable[[DataFrame], DataFrame], large: Callable[[DataFrame], DataFrame],
    n: str | None = None, whole: int = WHOLE,
) -> DataFrame:
    """small() of the rows of groups that one task may order, and large() of the others. `n` names a column that says how often a row
    counts. At most SHARE groups are large, so their keys are broadcast."""
    sizes = rows.groupBy(*keys).agg((F.sum(n) if n else F.count("*")).alias("_rows"))
    most = F.greatest(F.lit(whole), sizes.agg(F.sum("_rows") / SHARE).scalar())
    many = F.broadcast(sizes.where(F.col("_rows") > most).select(*keys))
    return small(rows.join(many, list(keys), "left_anti")).unionByName(large(rows.join(many, list(keys), "left_semi")))


def size_parts(rows: DataFrame, key: str, whole: int = WHOLE) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys that one task may hold, and those of the others, or None without any. At most SHARE keys are large, so they are
    looked up once, and plans over the small ones need not hold the large ones' steps. Rows are read more than once."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("_rows"))
    most = F.greatest(F.lit(whole), sizes.agg(F.sum("_rows") / SHARE).scalar())
    many = sizes.where(F.col(key).isNotNull() & (F.col("_rows") > most)).select(key).collect()
    if not many:
        return rows, None
    keys = F.broadcast(rows.sparkSession.createDataFrame(many, rows.select(key).schema))
    return rows.join(keys, key, "left_anti"), rows.join(keys, key, "left_semi")


def whole_sums(df: DataFrame, order: str, measures: list[str], keys: tuple[str, ...]) -> DataFrame:
    """running_sums of groups that one task may order."""
    group = Window.partitionBy(*keys)
    before = group.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({f"{m}_before": F.coalesce(F.sum(m).over(before), F.lit(0)) for m in measures}).withColumns({f"{m}_total": F.sum(m).over(group) for m in measures})


def running_sums(
    df: DataFrame, order: str, measures: list[str], keys: tuple[str, ...] = (), tie: tuple[str, ...] = (), few: bool = False,
) -> DataFrame:
    """Add `<m>_before` (sum over earlier rows of the group) and `<m>_total` for every measure.

    Rows must be unique per (keys, order, tie); keys must not be null. `few` says that the groups are few and large.
    """
    rows = split(df, order, "ordered") if few else binned(df, order, keys, "ordered")
    per_bin = rows.groupBy(*keys, "_bin").agg(*[F.sum(m).alias(f"_s_{m}") for m in measures])
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bin.select(
        *keys, "_bin",
        *[F.coalesce(F.sum(f"_s_{m}").over(earlier), F.lit(0)).alias(f"_off_{m}") for m in measures],
        *[F.sum(f"_s_{m}").over(group).alias(f"{m}_total") for m in measures])
    inside = Window.partitionBy(*keys, "_bin").orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(offsets, [*keys, "_bin"]).withColumns({
        f"{m}_before": F.col(f"_off_{m}") + F.coalesce(F.sum(m).over(inside), F.lit(0)) for m in measures
    }).drop("_bin", *[f"_off_{m}" for m in measures])


def quantile_arrays(
    df: DataFrame, x: str, qs: Column, keys: tuple[str, ...] = (), name: str = "quantiles", method: str = "linear",
    few: bool = False, count: str | None = None, stored: bool = False, whole: int = WHOLE, small: bool = False,
) -> DataFrame:
    """Exact quantiles per group as one array, in the order of the array column `qs`.

    Equal values are counted before anything is sorted. Small groups are ranked whole; in the others the bins that hold a wanted rank are
    found from bin totals, and only those bins are ranked. `method` is 'linear' interpolation or the 'nearest' rank. `few` says that
    the groups are few and large, so that their rows are split by split points; `count` names a column that says how often a row
    counts. `stored` says that df is read from storage, so it may be read more than once: rows of small groups then move once. `small`
    says that size_parts() found every group small.
    """
    def counted(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys, F.col(x).cast("double").alias("_x")).agg((F.sum(count) if count else F.count("*")).alias("_n"))

    def positions(total: Column) -> Column:
        at = F.transform(qs.cast("array<double>"), lambda q: q * (total - 1))
        return F.transform(at, lambda p: F.floor(p + 0.5).cast("double")) if method == "nearest" else at

    def rank(pos: Column, i: Column, side: int) -> Column:
        r = F.floor(pos) if side == 0 else F.ceil(pos)
        return F.struct((i * 2 + side).alias("slot"), r.alias("rank"), (pos - F.floor(pos)).alias("frac"))

    def ranks_within(start: str, n: str) -> Column:
        ranks = F.concat(F.transform("_q", lambda p, i: rank(p, i, 0)), F.transform("_q", lambda p, i: rank(p, i, 1)))
        return F.filter(ranks, lambda r: (r["rank"] >= F.col(start)) & (r["rank"] < F.col(start) + F.col(n)))

    def found(hits: DataFrame) -> DataFrame:
        slots = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(
            F.struct(F.col("_r.slot").alias("slot"), F.col("_x").alias("x"), F.col("_r.frac").alias("frac")))).alias("_slots"))
        pairs = F.sequence(F.lit(0), (F.size("_slots") / 2).cast("int") - 1)
        low, high = (lambda i: F.get("_slots", i * 2)), (lambda i: F.get("_slots", i * 2 + 1))
        return slots.select(*keys, F.transform(pairs, lambda i: low(i)["x"] + (high(i)["x"] - low(i)["x"]) * low(i)["frac"]).alias(name))

    def ranked_whole(counts: DataFrame) -> DataFrame:
        placed = whole_sums(counts, "_x", ["_n"], keys).withColumn("_q", positions(F.col("_n_total")))
        return found(placed.select(*keys, "_x", F.explode(ranks_within("_n_before", "_n")).alias("_r")))

    def ranked_in_bins(counts: DataFrame) -> DataFrame:
        counts = split(counts, "_x", "counts") if few else binned(counts, "_x", keys, "counts")
        # the join below implies these filters; stating them here keeps both readers of the counts alike, so they share one shuffle
        for c in (*keys, "_bin"):
            counts = counts.where(F.col(c).isNotNull())
        per_bin = counts.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_m"))
        group = Window.partitionBy(*keys)
        spans = per_bin.select(
            *keys, "_bin", F.col("_m"), F.sum("_m").over(group).alias("_total"),
            F.coalesce(F.sum("_m").over(group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_lo"))
        spans = spans.withColumn("_q", positions(F.col("_total")))
        wanted = spans.select(*keys, "_bin", "_lo", ranks_within("_lo", "_m").alias("_ranks")).where(F.size("_ranks") > 0)
        inside = Window.partitionBy(*keys, "_bin").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.join(wanted, [*keys, "_bin"]).withColumn(
            "_start", F.col("_lo") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        return found(placed.select(*keys, "_x", F.explode(F.filter(
            "_ranks", lambda r: (r["rank"] >= F.col("_start")) & (r["rank"] < F.col("_start") + F.col("_n")))).alias("_r")))

    rows = df.where(F.col(x).isNotNull())
    if not keys or few:
        return ranked_in_bins(counted(rows))
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    if small:
        return ranked_whole(counted(rows.repartition(*keys)))
    if stored:
        return by_size(rows, keys, lambda r: ranked_whole(counted(r.repartition(*keys))), lambda r: ranked_in_bins(counted(r)), count, whole)
    return by_size(counted(rows), keys, ranked_whole, ranked_in_bins, "_n", whole)


def quantiles(
    df: DataFrame, x: str, qs: dict[str, float], keys: tuple[str, ...] = (), method: str = "linear", few: bool = False,
    stored: bool = False, whole: int = WHOLE,
) -> DataFrame:
    """Exact quantiles per group, one named column each."""
    arrays = quantile_arrays(df, x, F.array(*[F.lit(float(q)) for q in qs.values()]), keys, "_v", method, few, stored=stored, whole=whole)
    return arrays.select(*keys, *[F.get("_v", F.lit(i)).alias(n) for i, n in enumerate(qs)])


def weighted_quantiles(
    df: DataFrame, x: str, w: str, qs: dict[str, float], keys: tuple[str, ...], tie: tuple[str, ...] = (), spread: str | None = None,
    whole: int = WHOLE,
) -> DataFrame:
    """Weighted quantiles by cumulative midpoints with linear interpolation, clamped at both ends.

    Rows are ordered by x, then by tie, or by weight without one. Inside a run of equal x the interpolation gives x, so of each run
    only its weight and the weights of its first and last row matter; its two outer midpoints stand for all of them. Rows of small
    groups move once; of the others, one row per (keys, x) is shuffled. The two midpoints that bracket a quantile come from plain
    aggregates. `spread` names a column for the weighted standard deviation around the finished mean. df is read more than once.
    """
    order = F.struct(*tie) if tie else F.col(w)
    ends = (F.min_by(w, order), F.max_by(w, order)) if tie else (F.min(w), F.max(w))
    sums = ["_w", "_wx"] if spread else ["_w"]

    def runs_of(rows: DataFrame) -> DataFrame:
        runs = rows.groupBy(*keys, x).agg(F.sum(w).alias("_w"), ends[0].alias("_first"), ends[1].alias("_last"))
        return runs.withColumn("_wx", F.col("_w") * F.col(x)) if spread else runs

    def brackets(placed: DataFrame) -> DataFrame:
        first = (F.col("_w_before") + F.col("_first") / 2) / F.col("_w_total")
        last = (F.col("_w_before") + F.col("_w") - F.col("_last") / 2) / F.col("_w_total")
        gap = F.col(x) - F.col("_wx_total") / F.col("_w_total") if spread else F.lit(0.0)
        placed = placed.select(*keys, x, F.least(first, last).alias("_lo"), F.greatest(first, last).alias("_hi"), (F.col("_w") / F.col("_w_total") * gap * gap).alias("_gap"))
        aggs = [F.sqrt(F.sum("_gap")).alias(spread)] if spread else []
        lo, hi = F.col("_lo"), F.col("_hi")
        for name, q in qs.items():
            below, above = F.when(hi <= q, hi).when(lo <= q, lo), F.when(lo > q, lo).when(hi > q, hi)
            aggs += [F.max(below).alias(f"_a_{name}"), F.max_by(x, below).alias(f"_xa_{name}"), F.min(above).alias(f"_b_{name}"), F.min_by(x, above).alias(f"_xb_{name}")]
        return placed.groupBy(*keys).agg(*aggs)

    def value(name: str, q: float) -> Column:
        a, xa, b, xb = (F.col(f"{p}_{name}") for p in ("_a", "_xa", "_b", "_xb"))
        return F.when(a.isNull(), xb).when(b.isNull(), xa).otherwise(xa + (xb - xa) * ((F.lit(q) - a) / (b - a)))

    rows = df.where(F.col(x).isNotNull()).select(*dict.fromkeys((*keys, x, w, *tie)))
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    found = by_size(
        rows, keys, lambda r: brackets(whole_sums(runs_of(r.repartition(*keys)), x, sums, keys)),
        lambda r: brackets(running_sums(runs_of(r), x, sums, keys)), whole=whole)
    return found.select(*keys, *[value(n, q).alias(n) for n, q in qs.items()], *([spread] if spread else []))


def dense_index(df: DataFrame, name: str, order: Column, index: str, first: Column | None = None) -> DataFrame:
    """Number unique rows 0..n-1 in the order of (`first`, `order`, `name`) without a global sort.

    `order` must be a hexadecimal digest: its first three digits split the rows into 4,096 even buckets, so a
    bucket's offset comes from a table of fixed size and only rows of one bucket are sorted together.
    """
    lead = first if first is not None else F.lit(0)
    rows = df.withColumns({"_lead": lead, "_hash": order}).withColumn("_bucket", F.substring("_hash", 1, 3))
    sizes = rows.groupBy("_lead", "_bucket").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_lead", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_lead", "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_lead", "_bucket").orderBy("_hash", name)
    return rows.join(offsets, ["_lead", "_bucket"]).withColumn(
        index, F.col("_offset") + F.row_number().over(inside) - 1).drop("_lead", "_hash", "_bucket", "_offset")
