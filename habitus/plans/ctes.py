"""Shared pieces of the checking SQL: the same views the Spark side builds, written independently for DuckDB."""

TXN = """txn AS (
  SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey * 1000000 + l_suppkey AS version,
    concat(l_orderkey, '-', l_linenumber) AS transaction_id,
    CAST(c_nationkey AS BIGINT) AS branch_id, CAST(c_custkey AS VARCHAR) AS origin_account_no,
    concat(c_nationkey, ':', c_custkey) AS entity_key, CAST(c_custkey AS VARCHAR) AS identifier,
    CAST(c_custkey AS VARCHAR) AS customer_key,
    CASE WHEN c_acctbal < 9000 THEN concat('22', lpad(CAST(c_custkey AS VARCHAR), 9, '0')) END AS bvn,
    c_name AS customer_name, concat(lower(replace(c_name, '#', '.')), '@example.com') AS customer_email,
    CASE WHEN l_orderkey % 200 = 0 THEN -1::DOUBLE WHEN l_orderkey % 200 = 100 THEN 2e13::DOUBLE
         ELSE l_extendedprice END AS amount,
    CASE r_regionkey WHEN 0 THEN 'naira' WHEN 1 THEN 'USD' WHEN 2 THEN ' Pound ' WHEN 3 THEN 'EURO' END AS currency,
    CASE WHEN l_linenumber % 2 = 0 THEN lower(o_orderpriority) ELSE concat(' ', o_orderpriority) END AS transaction_type,
    CASE WHEN l_returnflag = 'R' AND l_discount >= 0.09::DOUBLE THEN 'suspicious'
         WHEN l_tax = 0.08::DOUBLE AND l_linenumber = 7 THEN NULL ELSE 'clean' END AS status,
    (l_discount = 0.1::DOUBLE AND l_linestatus = 'O') AS is_blocked, c_acctbal < 0 AS sender_blacklisted,
    CASE WHEN l_partkey % 50 <> 0 THEN CAST(l_suppkey AS VARCHAR) END AS destination_account_no,
    CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN lower(c_mktsegment) END AS account_type,
    concat('no ', l_linenumber, ' street, ', n.n_name, ', ', r_name) AS customer_location,
    concat('102.', c_custkey % 200, '.', l_suppkey % 50, '.', l_linenumber) AS customer_ip_address,
    n.n_name AS origin_country, sn.n_name AS destination_country,
    o_orderdate + to_seconds((l_orderkey * 7919 + l_linenumber * 613) % 86400) AS ts,
    concat('Brand#', l_partkey % 25) AS merchant_name
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation n ON c_nationkey = n.n_nationkey JOIN region ON n.n_regionkey = r_regionkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey)"""

SANE = "sane AS (SELECT * FROM txn WHERE amount > 0 AND amount <= 1e13 AND ts IS NOT NULL)"

UNIQ = """uniq AS (SELECT * FROM sane QUALIFY row_number() OVER (
    PARTITION BY branch_id, transaction_id ORDER BY ts, id, version, amount) = 1)"""

CLEAN = "clean AS (SELECT * FROM uniq WHERE status = 'clean' AND NOT is_blocked AND NOT sender_blacklisted)"

# model layer: validated rows, weak label, clean rows, eligible customers (20 transactions over 30 days here)
VALID = """valid AS (SELECT * FROM (SELECT * FROM txn QUALIFY row_number() OVER (
    PARTITION BY transaction_id ORDER BY ts, id, version, amount) = 1) WHERE amount > 0 AND amount <= 1e13)"""

LABELLED = """labelled AS (SELECT *, (coalesce(lower(status) <> 'clean', false) OR coalesce(is_blocked, false)
    OR coalesce(sender_blacklisted, false)) AS bad FROM valid)"""

ELIGIBLE = """eligible AS (SELECT customer_key FROM labelled WHERE NOT bad GROUP BY customer_key
    HAVING count(*) >= 20 AND (epoch_us(max(ts)) - epoch_us(min(ts))) // 86400000000 >= 30)"""

TRAIN = "train AS (SELECT * FROM labelled WHERE NOT bad AND customer_key IN (SELECT customer_key FROM eligible))"


def with_(*parts: str) -> str:
    """WITH clause over the parts, in order."""
    return "WITH " + ",\n".join(parts) + "\n"


PROFILE_BASE = (TXN, SANE, UNIQ, CLEAN)
MODEL_BASE = (TXN, VALID, LABELLED, ELIGIBLE, TRAIN)
