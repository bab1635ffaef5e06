"""Table loading and the canonical transaction view over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from habitus.session import prepare

# Total order of transactions: time first, then the row identity. Every tie-break in the library uses it.
ORDER = ("ts", "id", "version", "amount")
# What transactions are partitioned by; the transaction id decides it.
ORDERED = ("l_orderkey",)
SUPPLIERS = 1_000_000  # a table of at most so many pairs of numbers is broadcast


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one parquet table; timestamps without a zone become UTC timestamps."""
    prepare(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a scan that gives fewer tasks than there are cores (one small file); larger inputs keep their own splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def transactions(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Canonical transactions derived from the sales tables (column contract in FIXTURES.md, part B), and source columns to `keep`.

    Buyers are joined to their orders, of which there are fewer, and the lines meet them last, on the order key: the rows
    stay partitioned by it, and whoever keeps that column can group lines of an order without moving them. What a line's flags say is
    worked out before it moves. Suppliers are two numbers each; up to SUPPLIERS of them are broadcast, for else all lines would move to
    their suppliers first. The other small dimensions are left to the optimizer, which broadcasts them only while their measured size
    is under its threshold.
    """
    line = load(spark, sf_dir, "lineitem").withColumns({
        "_suspicious": F.expr("l_returnflag = 'R' AND l_discount >= 0.09D"), "_unknown": F.expr("l_tax = 0.08D AND l_linenumber = 7"),
        "_blocked": F.expr("l_discount = 0.1D AND l_linestatus = 'O'")})
    line = spread(line, "l_orderkey")
    orders = load(spark, sf_dir, "orders")
    customer = load(spark, sf_dir, "customer")
    nation = load(spark, sf_dir, "nation")
    region = load(spark, sf_dir, "region")
    supplier = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    supplier = F.broadcast(supplier) if supplier.count() <= SUPPLIERS else supplier
    supplier_nation = nation.select(F.col("n_nationkey").alias("s_key"), F.col("n_name").alias("s_nation"))
    buyers = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    sold = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(supplier_nation, F.col("s_nationkey") == F.col("s_key"))
    joined = sold.join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
    branch, account = F.col("c_nationkey").cast("long"), F.col("c_custkey").cast("string")
    seconds = F.expr("(l_orderkey * 7919 + l_linenumber * 613) % 86400")
    return joined.select(
        F.expr("l_orderkey * 8 + l_linenumber").alias("id"),
        F.expr("l_partkey * 1000000 + l_suppkey").alias("version"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("transaction_id"),
        branch.alias("branch_id"),
        account.alias("origin_account_no"),
        F.concat(branch.cast("string"), F.lit(":"), account).alias("entity_key"),
        account.alias("identifier"),
        account.alias("customer_key"),
        F.expr("CASE WHEN c_acctbal < 9000 THEN concat('22', lpad(cast(c_custkey AS string), 9, '0')) END").alias("bvn"),
        F.col("c_name").alias("customer_name"),
        F.expr("concat(lower(replace(c_name, '#', '.')), '@example.com')").alias("customer_email"),
        F.expr("CASE WHEN l_orderkey % 200 = 0 THEN -1D WHEN l_orderkey % 200 = 100 THEN 2e13D "
               "ELSE l_extendedprice END").alias("amount"),
        F.expr("CASE r_regionkey WHEN 0 THEN 'naira' WHEN 1 THEN 'USD' WHEN 2 THEN ' Pound ' "
               "WHEN 3 THEN 'EURO' END").alias("currency"),
        F.expr("CASE WHEN l_linenumber % 2 = 0 THEN lower(o_orderpriority) "
               "ELSE concat(' ', o_orderpriority) END").alias("transaction_type"),
        F.expr("CASE WHEN _suspicious THEN 'suspicious' WHEN _unknown THEN NULL ELSE 'clean' END").alias("status"),
        F.col("_blocked").alias("is_blocked"),
        F.expr("c_acctbal < 0").alias("sender_blacklisted"),
        F.expr("CASE WHEN l_partkey % 50 <> 0 THEN cast(l_suppkey AS string) END").alias("destination_account_no"),
        F.expr("CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN lower(c_mktsegment) END").alias("account_type"),
        F.expr("concat('no ', l_linenumber, ' street, ', n_name, ', ', r_name)").alias("customer_location"),
        F.expr("concat('102.', c_custkey % 200, '.', l_suppkey % 50, '.', l_linenumber)").alias("customer_ip_address"),
        F.col("n_name").alias("origin_country"),
        F.col("s_nation").alias("destination_country"),
        F.timestamp_add("SECOND", seconds, F.col("o_orderdate")).alias("ts"),
        F.expr("concat('Brand#', l_partkey % 25)").alias("merchant_name"),
        *keep,
    )


def event_stream_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a second transaction source: user, time, amount, category and a nested field."""
    events = load(spark, sf_dir, "events")
    return events.select(
        "event_id",
        F.col("user_id").cast("string").alias("customer_key"),
        "ts",
        F.col("value").alias("amount"),
        F.col("event_type").alias("category"),
        F.from_json("props", "k long").getField("k").alias("k"),
    )
