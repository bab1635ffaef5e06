"""Geo velocity against the customer's previous resolved point: the batch form and the event view it shares with the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from habitus.config import DEFAULTS
from habitus.functions.geo import geo_velocity_kmh, haversine_km
from habitus.operators.velocity import HOUR, previous_value


def event_points(events: DataFrame) -> DataFrame:
    """Events with a position; failed events have none."""
    ok = F.col("category") != "error"
    return events.select(
        F.col("event_id").alias("id"), "customer_key", "ts",
        F.when(ok, F.col("amount") / 10).alias("lat"), F.when(ok, F.col("amount") / 5).alias("lon"))


def with_geo_velocity(points: DataFrame, retain_hours: int = DEFAULTS.geo_retain_hours) -> DataFrame:
    """Add the time of the previous resolved point, if it is recent enough, and the speed since then."""
    point = F.when(F.col("lat").isNotNull(), F.struct(F.unix_micros("ts").alias("us"), "lat", "lon"))
    out = previous_value(points, point, "_p", tie=("id",))
    gap = F.unix_micros("ts") - F.col("_p.us")
    kept = F.when(gap <= retain_hours * HOUR, F.col("_p"))
    km = haversine_km(kept["lat"], kept["lon"], F.col("lat"), F.col("lon"))
    return out.withColumns({
        "prev_us": kept["us"], "kmh": F.when(kept.isNotNull() & F.col("lat").isNotNull(), geo_velocity_kmh(km, gap / 3.6e9))}).drop("_p")
