"""Learned customer baselines of the model layer, the population baseline and the drift watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from habitus.config import DEFAULTS, Settings, WEEKDAYS
from habitus.functions.maps import set_diff, top_buckets
from habitus.functions.normalize import canonical_location, canonical_type, days_between, decay_weight, ip_subnet_strict
from habitus.operators.ordered import WHOLE, by_size, quantile_arrays, quantiles, weighted_quantiles



def set_values() -> dict[str, Column]:
    """Value of each learned set for one row; null when the row has none."""
    kind = canonical_type("transaction_type")
    return {
        "locs": canonical_location("customer_location"),
        "countries": F.nullif(F.col("origin_country"), F.lit("")),
        "benefs": F.nullif(F.col("destination_account_no"), F.lit("")),
        "types": F.nullif(kind, F.lit("")),
        "ips": ip_subnet_strict("customer_ip_address"),
    }


def members(train: DataFrame, key: str = "customer_key", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(customer, set, value): everything a customer was seen with, of all kinds or some. Kept as rows, because a set has no size limit."""
    pairs = F.array(*[F.struct(F.lit(n).alias("kind"), v.alias("value")) for n, v in set_values().items() if kinds is None or n in kinds])
    return train.select(key, F.explode(pairs).alias("p")).where("p.value IS NOT NULL").select(
        key, F.col("p.kind").alias("kind"), F.col("p.value").alias("value")).distinct()


def set_sizes(member_rows: DataFrame, key: str = "customer_key") -> DataFrame:
    """Size of every learned set per customer."""
    return member_rows.groupBy(key).agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in set_values()])


def member_arrays(member_rows: DataFrame, kinds: list[str], key: str = "customer_key") -> DataFrame:
    """Sorted arrays of the sets named; call it only for sets whose largest size has been checked."""
    return member_rows.where(F.col("kind").isin(*kinds)).groupBy(key).agg(*[
        F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("value")))).alias(k) for k in kinds])


def set_summaries(
    rows: DataFrame, counted: tuple[str, ...], listed: tuple[str, ...], key: str = "customer_key", whole: int = WHOLE,
) -> DataFrame:
    """set_sizes of the sets `counted` beside member_arrays of those `listed`, straight from rows that are read from storage: rows of
    customers with few of them move once, with the values of these sets only."""
    kinds = {k: v for k, v in set_values().items() if k in (*counted, *listed)}
    values = rows.select(key, *[v.alias(f"_v_{k}") for k, v in kinds.items()])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"_v_{k}").alias("value")) for k in kinds]))

    def found(part: DataFrame) -> DataFrame:
        seen = part.select(key, each.alias("p")).where("p.value IS NOT NULL").select(key, "p.kind", "p.value").distinct()
        return seen.groupBy(key).agg(
            *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in counted],
            *[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("value")))).alias(k) for k in listed])

    return by_size(values, (key,), lambda part: found(part.repartition(key)), found, whole=whole)


def largest_sets(member_rows: DataFrame, key: str = "customer_key") -> dict[str, int]:
    """Largest size of each kind of set; five numbers."""
    sizes = member_rows.groupBy(key, "kind").agg(F.count("*").alias("n")).groupBy("kind").agg(F.max("n").alias("n"))
    return {r["kind"]: r["n"] for r in sizes.collect()}


def fit_baseline(train: DataFrame, half_life: float = DEFAULTS.half_life_days, as_of: Column | None = None, key: str = "customer_key") -> DataFrame:
    """Per customer: weighted amount statistics, undecayed maximum and normalised hour and weekday histograms.

    Weights are summed per amount first, so a customer who pays one amount often is one row from then on. The spread is
    taken around the finished mean; customers with a single amount have none, and get 1.
    """
    as_of = as_of if as_of is not None else train.agg(F.max("ts")).scalar()
    rows = train.withColumn("w", decay_weight(days_between(as_of, "ts"), half_life))
    w, a = F.col("w"), F.col("amount")
    hours = [F.sum(F.when(F.hour("ts") == h, w).otherwise(0.0)).alias(f"_h{h}") for h in range(24)]
    days = [F.sum(F.when(F.weekday("ts") == d, w).otherwise(0.0)).alias(f"_d{d}") for d in range(7)]
    agg = rows.groupBy(key).agg(
        F.count("*").alias("n"), F.sum(w).alias("_sw"), (F.sum(w * a) / F.sum(w)).alias("amt_mean"),
        F.min(a).alias("_least"), F.max(a).alias("amt_max"), *hours, *days)
    # a weight falls with age, so rows of one amount are ordered by it as they are by time
    middle = weighted_quantiles(rows.select(key, "amount", "w"), "amount", "w", {"amt_median": 0.5, "amt_p95": 0.95}, (key,), spread="_spread")
    return agg.join(middle, key, "left").select(
        key, "n", "amt_mean", F.when(F.col("_least") < F.col("amt_max"), F.col("_spread")).otherwise(1.0).alias("amt_std"), "amt_max",
        F.transform(F.array(*[f"_h{h}" for h in range(24)]), lambda v: v / F.col("_sw")).alias("hour_hist"),
        F.transform(F.array(*[f"_d{d}" for d in range(7)]), lambda v: v / F.col("_sw")).alias("dow_hist"), "amt_median", "amt_p95")


def population_baseline(train: DataFrame) -> DataFrame:
    """Median and 95th percentile of all amounts, for customers without a baseline."""
    return quantiles(train, "amount", {"amt_median": 0.5, "amt_p95": 0.95})


def watermark_of(df: DataFrame) -> DataFrame:
    """What the training data looked like: newest time and id, rows, distinct decile edges and the share per bin."""
    positive = df.where("amount > 0")
    deciles = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: i / 10)
    edges = quantile_arrays(positive, "amount", deciles, name="edges").select(
        F.array_sort(F.array_distinct("edges")).alias("edges"), F.lit(1).alias("_one"))
    head = newest_of(df).withColumn("_one", F.lit(1))
    shares = bin_shares(positive, edges.select("edges").scalar()).withColumn("_one", F.lit(1))
    return head.join(edges, "_one").join(shares.withColumnRenamed("share", "ref_share"), "_one").drop("_one", "bins_rows")


def newest_of(df: DataFrame) -> DataFrame:
    """The part of watermark_of() that needs no bins."""
    return df.agg(F.max("ts").alias("max_date"), F.max("id").alias("max_id"), F.count("*").alias("rows"))


def bin_shares(df: DataFrame, edges: Column) -> DataFrame:
    """Share of amounts per bin between the edges; the last bin is closed, outsiders only count in the total."""
    df = df.select("amount", edges.alias("_e"))
    e = F.col("_e")
    inside = (F.col("amount") >= F.get(e, F.lit(0))) & (F.col("amount") <= F.get(e, F.size(e) - 1))
    which = F.least(F.size(F.filter(e, lambda x: x <= F.col("amount"))), F.size(e) - 1) - 1
    counted = df.select(F.when(inside, which).alias("bin"), F.size(e).alias("k")).groupBy("bin").agg(F.count("*").alias("n"), F.max("k").alias("k"))
    packed = counted.agg(
        F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n")))).alias("m"),
        F.sum("n").alias("bins_rows"), F.max("k").alias("k"))
    share = F.transform(F.sequence(F.lit(0), F.col("k") - 2), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)) / F.col("bins_rows"))
    return packed.select(share.alias("share"), "bins_rows")


def psi(ref: Column, cur: Column, eps: float = 1e-6) -> Column:
    """Population stability index between two arrays of shares."""
    terms = F.zip_with(ref, cur, lambda r, c: ((c + eps) - (r + eps)) * F.ln((c + eps) / (r + eps)))
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def baseline_view(base: DataFrame, sizes: DataFrame, known: DataFrame | None = None, key: str = "customer_key", locations: int | None = None) -> DataFrame:
    """Readable view of learned baselines: rounded amounts, busiest hours and days, set sizes and members.

    A display may ask for the first few `locations` only; their full number is beside them. `sizes` may hold the members as well.
    """
    sets = base.join(sizes, key, "left")
    sets = sets.join(known, key, "left") if known is not None else sets
    places = F.coalesce("locs", F.array().cast("array<string>"))
    return sets.select(
        key, *[F.round(f"amt_{n}", 2).alias(n) for n in ("median", "mean", "p95", "max", "std")],
        top_buckets("hour_hist").alias("usual_hours"), top_buckets("dow_hist", labels=WEEKDAYS).alias("usual_days"),
        (places if locations is None else F.slice(places, 1, locations)).alias("known_locations"), F.coalesce("n_locs", F.lit(0)).alias("n_locations"), F.coalesce("n_benefs", F.lit(0)).alias("known_beneficiaries"),
        F.coalesce("types", F.array().cast("array<string>")).alias("known_types"), F.coalesce("n_ips", F.lit(0)).alias("known_subnets"))


def set_changes(prev_members: DataFrame, cur_members: DataFrame, key: str = "customer_key") -> DataFrame:
    """Added, removed and kept values per customer and set, counted from the member rows of two builds."""
    both = prev_members.withColumn("_p", F.lit(1)).join(cur_members.withColumn("_c", F.lit(1)), [key, "kind", "value"], "full_outer")
    added, removed = F.col("_p").isNull(), F.col("_c").isNull()
    return both.groupBy(key, "kind").agg(
        F.count_if(added).alias("added"), F.count_if(removed).alias("removed"), F.count_if(~added & ~removed).alias("kept"))


def set_changes_since(train: DataFrame, was: Column, key: str = "customer_key", current: DataFrame | None = None) -> DataFrame:
    """set_changes of two builds over the same stored rows: all of them, and before that those where `was` holds. Customers that are
    not among the keys of `current`, if given, have no current sets. Rows of customers with few of them move once."""
    pairs = F.array(*[F.struct(F.lit(n).alias("kind"), v.alias("value")) for n, v in set_values().items()])
    rows = train.select(key, F.coalesce(was, F.lit(False)).alias("_was"), pairs.alias("_pairs"))

    def changed(part: DataFrame) -> DataFrame:
        each = part.select(key, "_was", F.explode("_pairs").alias("p")).where("p.value IS NOT NULL")
        values = each.groupBy(key, F.col("p.kind").alias("kind"), F.col("p.value").alias("value")).agg(F.bool_or("_was").alias("_was"))
        return values.groupBy(key, "kind").agg(F.count_if("_was").alias("_old"), F.count("*").alias("_all"))

    counts = by_size(rows, (key,), lambda part: changed(part.repartition(key)), changed)
    known = F.lit(True)
    if current is not None:
        counts = counts.join(current.select(key, F.lit(True).alias("_known")), key, "left")
        known = F.coalesce("_known", F.lit(False))
    return counts.where((F.col("_old") > 0) | known).select(
        key, "kind", F.when(known, F.col("_all") - F.col("_old")).otherwise(0).alias("added"), F.when(known, 0).otherwise(F.col("_old")).alias("removed"),
        F.when(known, F.col("_old")).otherwise(0).alias("kept"))


def diff_baselines(prev: DataFrame, cur: DataFrame, key: str = "customer_key") -> DataFrame:
    """Full-outer comparison of two builds: what happened to each customer and how far the median moved."""
    p = prev.select(key, F.col("amt_median").alias("prev_median"), F.col("hour_hist").alias("_ph"), F.lit(True).alias("_p"))
    c = cur.select(key, F.col("amt_median").alias("cur_median"), F.col("hour_hist").alias("_ch"), F.lit(True).alias("_c"))
    transition = (
        F.when(F.col("_p").isNull(), "newly_learned").when(F.col("_c").isNull(), "invalidated_to_coldstart").otherwise("relearned"))
    return p.join(c, key, "full_outer").select(
        key, transition.alias("transition"), F.round("prev_median", 2).alias("prev_median"), F.round("cur_median", 2).alias("cur_median"),
        F.round(F.col("cur_median") - F.col("prev_median"), 2).alias("median_shift"),
        top_buckets("_ph").alias("prev_hours"), top_buckets("_ch").alias("cur_hours"))


