"""Partitioned reads of a remote database: filters run there, and the watermark bounds the partitions."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession, functions as F

ROWS_PER_PART = 200_000


def scan(spark: SparkSession, url: str, table: str, low: int, high: int, parts: int, column: str = "id", fetch: int = 10_000, **options: str) -> DataFrame:
    """A table in `parts` ranges of a numeric column, read at the same time; filters on the result run in the database."""
    settings = {"url": url, "dbtable": table, "partitionColumn": column, "lowerBound": str(low), "upperBound": str(max(high, low + 1)), "numPartitions": str(parts), "fetchsize": str(fetch)}
    return spark.read.format("jdbc").options(**settings, **options).load()


def extent(spark: SparkSession, url: str, table: str, last_id: int, column: str = "id", **options: str) -> tuple[int, int]:
    """Highest id and number of rows beyond the watermark, asked of the database."""
    query = f"SELECT MAX({column}) AS high, COUNT(*) AS n FROM {table} WHERE {column} > {int(last_id)}"
    row = spark.read.format("jdbc").options(url=url, query=query, **options).load().first()
    return int(row[0] if row[0] is not None else last_id), int(row[1])


def pull_new(spark: SparkSession, url: str, table: str, last_id: int, column: str = "id", rows_per_part: int = ROWS_PER_PART, **options: str) -> DataFrame:
    """Rows beyond the watermark, in as many partitions as their number asks for."""
    high, n = extent(spark, url, table, last_id, column, **options)
    parts = max(1, ceil(n / rows_per_part))
    return scan(spark, url, table, last_id, high, parts, column, **options).where((F.col(column) > last_id) & (F.col(column) <= high))


def extract(spark: SparkSession, url: str, table: str, start: str, ts: str = "ts", column: str = "id", account: str = "origin_account_no", branch: int | None = None,
            rows_per_part: int = ROWS_PER_PART, **options: str) -> DataFrame:
    """Rows with an account from a moment on (text like 2000-01-31 00:00:00), of one branch if asked; all of it is filtered in the database."""
    high, n = extent(spark, url, table, -1, column, **options)
    rows = scan(spark, url, table, 0, high, max(1, ceil(n / rows_per_part)), column, **options).where((F.col(ts) >= F.lit(start).cast("timestamp")) & F.col(account).isNotNull())
    return rows.where(F.col("branch_id") == branch) if branch is not None else rows
