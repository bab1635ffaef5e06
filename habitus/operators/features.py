"""The 27-column deviation matrix: each transaction against its customer's learned baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from habitus.config import DEFAULTS, FEATURES, Settings
from habitus.functions.normalize import days_between, decay_weight, is_night
from habitus.operators import baseline as B, filters as L, graph as G, velocity as V
from habitus.operators.ordered import WHOLE, by_size, quantiles, size_parts
from habitus.operators.salted import salted_join
from habitus.session import materialize

EPS = 1e-9
TEXT = ("customer_location", "origin_country", "destination_country", "destination_account_no", "transaction_type", "customer_ip_address")
NOVELTY = {"locs": "location_new", "countries": "country_new", "benefs": "beneficiary_new", "types": "type_rare", "ips": "ip_new"}


def flag(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)


def amount_features() -> dict[str, Column]:
    """Amount against the baseline columns; without a baseline, against the population medians."""
    a, cold = F.coalesce(F.col("amount"), F.lit(0.0)), F.col("amt_max").isNull()
    return {
        "amt_log": F.log1p(a),
        "amt_z": F.when(cold, 0.0).otherwise((a - F.col("amt_mean")) / (F.col("amt_std") + EPS)),
        "amt_over_median": a / (F.coalesce("amt_median", "pop_median") + EPS),
        "amt_over_p95": a / (F.coalesce("amt_p95", "pop_p95") + EPS),
        "amt_over_max": F.when(cold, 0.0).otherwise(a / (F.col("amt_max") + EPS)),
        "above_max": flag(a > F.col("amt_max")),
    }


def rarity(hist: str, position: Column) -> Column:
    """How far a bucket is below the customer's peak: 0 at the peak, 1 where never seen, 0.5 without a baseline."""
    peak = F.coalesce(F.nullif(F.array_max(hist), F.lit(0.0)), F.lit(1.0))
    share = F.coalesce(F.get(F.col(hist), position), F.lit(0.0))
    return F.when(F.col(hist).isNull(), 0.5).otherwise(F.least(F.greatest(1.0 - share / peak, F.lit(0.0)), F.lit(1.0)))


def time_features() -> dict[str, Column]:
    return {
        "hour_rarity": rarity("hour_hist", F.hour("ts")), "dow_rarity": rarity("dow_hist", F.weekday("ts")), "is_night": flag(is_night("ts"))}


def cross_border(origin: str = "origin_country", destination: str = "destination_country") -> Column:
    """Both countries known, and different."""
    o, d = F.col(origin), F.col(destination)
    return flag((o != "") & (d != "") & (F.lower(F.trim(o)) != F.lower(F.trim(d))))


def asked_of_sets(key: str = "customer_key") -> Column:
    """What a row asks of the learned sets, in 128 bits, from its values _v_<set>; nulls are told apart by the second half."""
    parts = [F.col(key), *[F.col(f"_v_{k}") for k in NOVELTY]]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("")) for p in parts]).alias("b"))


def novelty_values() -> dict[str, Column]:
    return {f"_v_{k}": v for k, v in B.set_values().items() if k in NOVELTY}


def with_questions(df: DataFrame, key: str = "customer_key") -> DataFrame:
    """Add what novelty needs of a row's text: `_asked`, and `_has_<set>` where the row has a value. The text itself may stay behind."""
    values = novelty_values()
    has = {f"_has_{k}": F.col(f"_v_{k}").isNotNull() for k in NOVELTY}
    return df.withColumns(values).withColumns({"_asked": asked_of_sets(key)} | has).drop(*values)


def with_novelty(df: DataFrame, member_rows: DataFrame, key: str = "customer_key", sized: bool = False, counted: DataFrame | None = None) -> DataFrame:
    """Add the five novelty flags: the customer has a learned set, the row has a value, and the set lacks it.

    The distinct values of the rows are stacked and looked up by (customer, set, value) in one join, which spreads even one
    customer's lookups over the cluster; each row then gets its five answers in one join. `sized` says that the rows have the
    set sizes already; they are dropped.
    """
    counted = counted if counted is not None else df
    out = df if sized else salted_join(df, B.set_sizes(member_rows, key), key, counted)
    values = novelty_values()
    asks = counted.select(key, *[v.alias(n) for n, v in values.items()]).select(asked_of_sets(key).alias("_asked"), key, *values)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"_v_{k}").alias("value")) for k in NOVELTY]))
    stacked = asks.distinct().select("_asked", key, each.alias("_v")).select("_asked", key, "_v.kind", "_v.value").where("value IS NOT NULL")
    learned = member_rows.select(key, "kind", "value", F.lit(True).alias("_in"))
    known = [F.count_if((F.col("kind") == k) & F.col("_in")).alias(f"_in_{k}") for k in NOVELTY]
    answers = stacked.join(learned, [key, "kind", "value"], "left").groupBy("_asked").agg(*known)
    # the values are read before the rows move to their answers; from then on a row only knows which of its values may be new
    out = out if "_asked" in out.columns else with_questions(out, key)
    out = out.withColumns({f"_may_{k}": (F.col(f"n_{k}") > 0) & F.col(f"_has_{k}") for k in NOVELTY}).drop(*[f"_has_{k}" for k in NOVELTY])
    out = salted_join(out, answers, "_asked", asks)
    flags = {name: flag(F.col(f"_may_{k}") & (F.col(f"_in_{k}") == 0)) for k, name in NOVELTY.items()}
    return out.withColumns(flags).drop("_asked", *(f"{c}_{k}" for k in NOVELTY for c in ("_in", "n", "_may")))


def novelty_since(
    rows: DataFrame, cut: Column, keep: str = "transaction_id", key: str = "customer_key", min_txns: int = DEFAULTS.ml_min_txns,
    min_days: int = DEFAULTS.ml_min_days, whole: int = WHOLE,
) -> DataFrame:
    """with_novelty of the rows from `cut` on, against what eligible customers were seen with in clean rows before it; `keep` and the flags.

    `rows` have their text, ts and bad, and are read from storage. Rows of customers with few of them move once, to their customer,
    and everything is found beside them; only customers with very many rows take the lookups of with_novelty.
    """
    later, mine = F.col("ts") >= cut, Window.partitionBy(key)

    def beside(part: DataFrame) -> DataFrame:
        moved = part.select(
            key, F.when(later, F.col(keep)).alias(keep), later.alias("_later"), F.when(~F.col("bad"), F.col("ts")).alias("_clean"),
            *[v.alias(n) for n, v in novelty_values().items()]).repartition(key)
        enough = (F.count("_clean").over(mine) >= min_txns) & (L.whole_days(F.min("_clean").over(mine), F.max("_clean").over(mine)) >= min_days)
        out = moved.withColumn("_learned", F.coalesce(F.col(key).isNotNull() & enough & (F.col("_clean") < cut), F.lit(False)))
        out = out.withColumns({f"_any_{k}": F.bool_or(F.col("_learned") & F.col(f"_v_{k}").isNotNull()).over(mine) for k in NOVELTY})
        out = out.withColumns({f"_in_{k}": F.bool_or("_learned").over(Window.partitionBy(key, f"_v_{k}")) for k in NOVELTY})
        flags = {name: flag(F.col(f"_any_{k}") & F.col(f"_v_{k}").isNotNull() & ~F.col(f"_in_{k}")) for k, name in NOVELTY.items()}
        return out.where("_later").select(keep, *[f.alias(n) for n, f in flags.items()])

    def apart(part: DataFrame) -> DataFrame:
        clean = part.where("NOT bad")
        train = L.only_eligible(clean.where(~later), L.ml_eligible(clean, min_txns, min_days))
        return with_novelty(part.where(later), B.members(train)).select(keep, *NOVELTY.values())

    return by_size(rows.where(later | ~F.col("bad")), (key,), beside, apart, whole=whole)


def entity_median(df: DataFrame, key: str = "customer_key") -> DataFrame:
    """Unweighted median amount per customer of a frame."""
    return quantiles(df, "amount", {"frame_median": 0.5}, (key,), stored=True)


def squashed(counted: DataFrame) -> DataFrame:
    """Velocity, hourly spend and recency features of rows with their windows and `frame_median`.

    The raw hourly spend and the usual amount stay as spent_1h and usual, for those who change the amount afterwards.
    """
    counted = counted.withColumns({"spent_1h": F.col("spend_1h"), "usual": F.coalesce(F.nullif(F.col("frame_median"), F.lit(0.0)), F.lit(1.0))})
    return V.velocity_features(counted, F.col("frame_median")).drop("frame_median")


def customer_rows(base: DataFrame, member_rows: DataFrame, graph: DataFrame | None = None, median: DataFrame | None = None) -> DataFrame:
    """All that is known of a customer in one row: baseline, set sizes, graph features and median."""
    out = base.drop("n").join(B.set_sizes(member_rows), "customer_key", "full")
    for more in (graph, median):
        out = out.join(more, "customer_key", "full") if more is not None else out
    return out


def with_population(df: DataFrame, population: DataFrame) -> DataFrame:
    """Two population numbers on every row, as scalar subqueries."""
    return df.withColumns({
        "pop_median": population.select("amt_median").scalar(), "pop_p95": population.select("amt_p95").scalar()})


def transform(
    txn: DataFrame, base: DataFrame, member_rows: DataFrame, population: DataFrame, graph: DataFrame | None = None,
    keep: tuple[str, ...] = (), median: DataFrame | None = None,
) -> DataFrame:
    """Feature matrix of a transaction table: keys, `keep`, the features in contract order and the cold-start flag.

    Cold-start customers get neutral deviations, but their velocity and graph features are computed like anyone's.
    """
    side = customer_rows(base, member_rows, graph, median if median is not None else entity_median(txn))
    # what needs a row's text is known before the row moves, so its text stays behind; it also keeps the generated code of one step small
    narrow = with_questions(txn.withColumn("cross_border", cross_border())).drop(*[c for c in TEXT if c not in keep])
    rows = squashed(salted_join(V.velocity(narrow), side, "customer_key", txn))
    return matrix(rows, member_rows, population, graph is not None, keep, txn)


def deviations(
    rows: DataFrame, base: DataFrame, member_rows: DataFrame, population: DataFrame, graph: DataFrame | None = None, keep: tuple[str, ...] = (),
    counted: DataFrame | None = None,
) -> DataFrame:
    """The matrix of rows that have their velocity and recency features already, however those were counted. `counted` may be
    a cheaper frame of the same transactions, to count keys on."""
    rows = salted_join(rows, customer_rows(base, member_rows, graph), "customer_key", counted)
    return matrix(rows, member_rows, population, graph is not None, keep, counted)


def matrix(
    rows: DataFrame, member_rows: DataFrame, population: DataFrame, graph: bool, keep: tuple[str, ...] = (), counted: DataFrame | None = None,
) -> DataFrame:
    """The matrix of rows that have their velocity features and their customer's row. Without a population, its numbers are null, and
    so are the two features that need them, until priced() knows them."""
    unknown = F.lit(None).cast("double")
    rows = with_population(rows, population) if population is not None else rows.withColumns({"pop_median": unknown, "pop_p95": unknown})
    border = {} if "cross_border" in rows.columns else {"cross_border": cross_border()}
    rows = rows.withColumns(amount_features() | time_features() | border | {"is_cold_start": F.col("amt_max").isNull()})
    rows = with_novelty(rows, member_rows, sized=True, counted=counted)
    rows = rows if graph else rows.withColumns({c: F.lit(0.0) for c in FEATURES[-3:]})
    return contract(rows, keep, PRICED if population is None else ())


PRICED = {"amt_over_median": "pop_median", "amt_over_p95": "pop_p95"}  # features of the amount that fall back on the population's


def finite(f: str, c: Column) -> Column:
    """A feature without nulls; not a number counts as above infinity."""
    return F.when(F.abs(c) < float("inf"), c).otherwise(0.0).alias(f)


def contract(rows: DataFrame, keep: tuple[str, ...] = (), later: tuple[str, ...] | dict = ()) -> DataFrame:
    """The columns of a matrix; features named in `later` are left as they are."""
    return rows.select("customer_key", "transaction_id", *keep, "is_cold_start", *[F.col(f) if f in later else finite(f, F.col(f)) for f in FEATURES])


def priced(rows: DataFrame, population: DataFrame) -> DataFrame:
    """Stored rows of a matrix that was made without the population, with its two numbers; they are read here."""
    found = population.first()
    pop = {c: F.lit(found[n] if found else None).cast("double") for c, n in (("pop_median", "amt_median"), ("pop_p95", "amt_p95"))}
    a = F.coalesce(F.col("amount"), F.lit(0.0))
    return rows.withColumns(pop | {f: finite(f, F.coalesce(f, a / (pop[c] + EPS))) for f, c in PRICED.items()})


def learned_matrix(
    rows: DataFrame, cut: Column, keep: tuple[str, ...] = (), min_txns: int = DEFAULTS.ml_min_txns, min_days: int = DEFAULTS.ml_min_days,
    half_life: float = DEFAULTS.half_life_days, whole: int = WHOLE,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """transform() of the clean rows of eligible customers before `cut` and of all rows from it on, both against what those clean rows
    teach, and the distinct payments (customer_key, destination_account_no, n) among them. `rows` have their text, ts and bad, and are
    read from storage. The past has `amount`, the later rows have `keep`, of which `bad` may be one.

    Rows of customers with few of them move once, to their customer, and everything but the popularity of counterparties is found beside
    them; customers with very many rows take the steps of transform(). Weights count from `cut`: baselines are ratios of them.
    """
    key, later = "customer_key", F.col("ts") >= cut
    mine, clean = Window.partitionBy(key), F.col("_clean")
    enough = (F.count(F.when(clean, 1)).over(mine) >= min_txns) & (
        L.whole_days(F.min(F.when(clean, F.col("ts"))).over(mine), F.max(F.when(clean, F.col("ts"))).over(mine)) >= min_days)
    few, many = size_parts(rows.where(F.col(key).isNotNull() & (later | ~F.col("bad"))), key, whole)
    learns = F.coalesce(clean & ~F.col("later") & enough, F.lit(False))

    paid = few.where("NOT bad").select(key, "ts", "destination_account_no", later.alias("later"), F.lit(True).alias("_clean")).repartition(key)
    edges = G.edge_counts(paid.withColumn("_learned", learns).where("_learned"))
    if many is not None:
        good = many.where("NOT bad")
        train = L.only_eligible(good.where(~later), L.ml_eligible(good, min_txns, min_days))
        edges = edges.unionByName(G.edge_counts(train))
    edges = materialize(edges, "edges")
    graph = materialize(G.edge_features(edges), "gfeat")

    moved = few.select(
        key, "transaction_id", "ts", "amount", "id", "version", later.alias("later"), (~F.col("bad")).alias("_clean"), cross_border().alias("cross_border"),
        *[v.alias(n) for n, v in novelty_values().items()]).repartition(key)
    known = moved.withColumn("_learned", learns).where("later OR _learned").withColumn("bad", ~F.col("_clean")).drop("_clean")
    stored = ["later", *dict.fromkeys(("amount", *keep))]
    found = contract(beside(known, mine, cut, half_life).join(graph, key, "left"), tuple(stored), PRICED)
    if many is not None:
        base, members = materialize(B.fit_baseline(train, half_life), "base"), materialize(B.members(train), "members")
        for is_later, part in ((False, train), (True, many.where(later))):
            made = transform(part, base, members, None, graph, tuple(dict.fromkeys(("amount", *keep)))).withColumn("later", F.lit(is_later))
            found = found.unionByName(made.select(*found.columns))
    # of the past, only the amount is asked for besides the features
    found = found.withColumns({c: F.when(F.col("later"), F.col(c)) for c in keep if c != "amount"})
    both = materialize(found, "matrix", ("later",))
    past, future = both.where("NOT later").drop("later", *[c for c in keep if c != "amount"]), both.where("later").drop("later")
    population = B.population_baseline(past.select("amount"))
    return priced(past, population), priced(future, population), edges


def beside(known: DataFrame, mine: Window, cut: Column, half_life: float) -> DataFrame:
    """All features but the graph's of rows that lie with those of their customer: `_learned` ones teach, `later` tells the two frames
    apart, of which each has its own windows of time. What transform() joins is a window here."""
    key, learned = "customer_key", F.col("_learned")
    frame = Window.partitionBy(key, "later")
    us, by_amount = F.unix_micros("ts"), frame.orderBy("amount")
    w = F.when(learned, decay_weight(days_between(cut, "ts"), half_life))
    out = known.withColumns({"_us": us, "_w": w})
    # novelty: the customer has a learned set, the row has a value, and the set lacks it
    for k, name in NOVELTY.items():
        value = F.col(f"_v_{k}")
        seen = F.bool_or("_learned").over(Window.partitionBy(key, f"_v_{k}"))
        out = out.withColumns({"_in": seen, "_any": F.bool_or(learned & value.isNotNull()).over(mine)})
        out = out.withColumn(name, flag(F.col("_any") & value.isNotNull() & ~F.col("_in"))).drop("_in", "_any", f"_v_{k}")
    # rarity of the hour and the weekday: their shares of the weight, against the largest share
    for name, bucket in (("hour_rarity", F.hour("ts")), ("dow_rarity", F.weekday("ts"))):
        out = out.withColumn("_bucket", bucket).withColumn("_share", F.sum("_w").over(Window.partitionBy(key, "_bucket")))
        peak = F.coalesce(F.nullif(F.max("_share").over(mine), F.lit(0.0)), F.lit(1.0))
        rare = F.least(F.greatest(1.0 - F.coalesce("_share", F.lit(0.0)) / peak, F.lit(0.0)), F.lit(1.0))
        out = out.withColumn(name, F.when(F.max("_w").over(mine).isNull(), 0.5).otherwise(rare)).drop("_bucket", "_share")
    # the baseline of amounts: like fit_baseline(), with the two outer midpoints of each run of equal amounts
    out = out.withColumns({
        "_sw": F.sum("_w").over(mine), "amt_mean": F.sum(F.col("_w") * F.col("amount")).over(mine) / F.sum("_w").over(mine),
        "_least": F.min(F.when(learned, F.col("amount"))).over(mine), "amt_max": F.max(F.when(learned, F.col("amount"))).over(mine)})
    run = Window.partitionBy(key, "later", "amount")
    out = out.withColumns({
        "_run": F.sum("_w").over(run), "_first": F.min("_w").over(run), "_last": F.max("_w").over(run),
        "_upto": F.sum("_w").over(by_amount.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
        "_i": F.row_number().over(by_amount) - 1 - (F.count("*").over(frame) - F.count("amount").over(frame)), "_n": F.count("amount").over(frame)})
    before = F.col("_upto") - F.col("_run")
    first, last = (before + F.col("_first") / 2) / F.col("_sw"), (F.col("_upto") - F.col("_last") / 2) / F.col("_sw")
    gap = F.col("amount") - F.col("amt_mean")
    out = out.withColumns({"_lo": F.least(first, last), "_hi": F.greatest(first, last), "_gap": F.col("_w") / F.col("_sw") * gap * gap, "_at": (F.col("_n") - 1) * 0.5})
    lo, hi, amount = F.col("_lo"), F.col("_hi"), F.col("amount")
    aggs = {"_spread": F.sqrt(F.sum("_gap").over(mine))}
    for name, q in (("amt_median", 0.5), ("amt_p95", 0.95)):
        below, above = F.when(hi <= q, hi).when(lo <= q, lo), F.when(lo > q, lo).when(hi > q, hi)
        a, xa, b, xb = F.max(below).over(mine), F.max_by(amount, below).over(mine), F.min(above).over(mine), F.min_by(amount, above).over(mine)
        aggs[name] = F.when(a.isNull(), xb).when(b.isNull(), xa).otherwise(xa + (xb - xa) * ((F.lit(q) - a) / (b - a)))
    low, high = (F.max(F.when(F.col("_i") == side(F.col("_at")), amount)).over(frame) for side in (F.floor, F.ceil))
    aggs["frame_median"] = low + (high - low) * (F.col("_at") - F.floor("_at"))
    out = out.withColumns(aggs).drop("_run", "_first", "_last", "_upto", "_i", "_n", "_lo", "_hi", "_gap", "_at", "_w", "_sw")
    known_max = F.col("amt_max").isNotNull()
    out = out.withColumn("amt_std", F.when(known_max, F.when(F.col("_least") < F.col("amt_max"), F.col("_spread")).otherwise(1.0))).drop("_spread", "_least")
    # velocity, as V.velocity counts it
    ordered, timed, money = frame.orderBy("_us", *V.TIE), frame.orderBy("_us"), F.col("amount").cast("decimal(18,2)")
    older = lambda span: timed.rangeBetween(Window.unboundedPreceding, -(span + 1))
    out = out.withColumns({
        "_pos": F.row_number().over(ordered) - 1, "prev_us": F.lag("_us").over(ordered),
        "_paid": F.sum(money).over(ordered.rowsBetween(Window.unboundedPreceding, 0))})
    out = out.withColumns({f"n_{n}": F.col("_pos") - F.count("*").over(older(m * 60_000_000)) for n, m in V.VELOCITY_MINUTES.items()} | {
        "spend_1h": (F.col("_paid") - F.coalesce(F.sum(money).over(older(V.HOUR)), F.lit(0))).cast("double")})
    unknown = F.lit(None).cast("double")
    out = squashed(out.drop("_pos", "_paid", "_us")).withColumns({"pop_median": unknown, "pop_p95": unknown})
    return out.withColumns(amount_features() | {"is_night": flag(is_night("ts")), "is_cold_start": F.col("amt_max").isNull()})


def baseline_or_peer(txn: DataFrame, base: DataFrame, peers: DataFrame, population: DataFrame) -> DataFrame:
    """Reference amounts per transaction: personal, or else the peer group's, or else the population's, with their origin."""
    own = base.select("customer_key", F.struct(F.col("amt_median").alias("median"), F.col("amt_p95").alias("p95")).alias("_own"))
    group = ["branch_id", "account_type", "currency"]
    peer = peers.select(*group, F.struct(F.col("median_amount").alias("median"), F.col("p95_amount").alias("p95")).alias("_peer"))
    out = with_population(txn.join(own, "customer_key", "left").join(peer, group, "left"), population)
    pop = F.struct(F.col("pop_median").alias("median"), F.col("pop_p95").alias("p95"))
    chosen = F.coalesce("_own", "_peer", pop)
    source = F.when(F.col("_own").isNotNull(), "personal").when(F.col("_peer").isNotNull(), "peer").otherwise("population")
    return out.withColumns({"ref_median": chosen["median"], "ref_p95": chosen["p95"], "baseline_type": source}).drop("_own", "_peer", "pop_median", "pop_p95")
