"""Transaction extracts as CSV: fixed schema, tolerant cells, zoned text timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from habitus.schemas import TXN_COLUMNS


def write_txn_csv(df: DataFrame, path: str) -> None:
    """Extract with a header; times are written with their UTC offset."""
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00"))
    df.withColumn("date_created", stamp).drop("ts").select(*[c for c in TXN_COLUMNS if c in [*df.columns, "date_created"]]).write.option("header", True).csv(path)


def read_txn_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read an extract; cells that do not fit their type become null and the row stays.

    Everything is read as text under a fixed schema (no inference pass), then cast tolerantly.
    """
    raw = spark.read.schema(", ".join(f"`{c}` string" for c in TXN_COLUMNS)).option("header", True).option("mode", "PERMISSIVE").csv(path)
    zoned = F.regexp_replace("date_created", r"([+-]\d{2})$", "$1:00")
    ts = F.try_to_timestamp(zoned)
    typed = {c: F.col(c).try_cast(t) for c, t in TXN_COLUMNS.items() if t != "string" and c != "date_created"}
    return raw.withColumns(typed | {"ts": ts}).drop("date_created")
