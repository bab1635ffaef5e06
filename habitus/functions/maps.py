"""Map, histogram and set helpers: text forms, JSON, busiest buckets and set differences."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from habitus.functions.normalize import as_column


def map_text(m: Column | str) -> Column:
    """A map as 'key=value' pairs in key order."""
    entries = F.array_sort(F.map_entries(as_column(m)))
    return F.coalesce(F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","), F.lit(""))


def map_to_json(m: Column | str) -> Column:
    """A {value: count} map as JSON text; null becomes an empty object."""
    return F.coalesce(F.to_json(as_column(m)), F.lit("{}"))


def json_to_map(c: Column | str) -> Column:
    """JSON text to a {value: count} map; blank or broken text becomes an empty map."""
    empty = F.create_map().cast("map<string,bigint>")
    parsed = F.from_json(F.coalesce(F.nullif(F.trim(as_column(c)), F.lit("")), F.lit("{}")), "map<string,bigint>")
    return F.coalesce(parsed, empty)


def top_buckets(hist: Column | str, k: int = 3, labels: tuple[str, ...] | None = None) -> Column:
    """Positions (or labels) of the k largest positive buckets; equal buckets keep their order."""
    ranked = F.array_sort(F.transform(as_column(hist), lambda v, i: F.struct((-v).alias("v"), i.alias("i"))))
    best = F.transform(F.filter(F.slice(ranked, 1, k), lambda e: e["v"] < 0), lambda e: e["i"])
    if labels is None:
        return best
    names = F.array(*[F.lit(x) for x in labels])
    return F.transform(best, lambda i: F.get(names, i))


def set_diff(prev: Column | str, cur: Column | str) -> Column:
    """What a learned set gained, lost and kept."""
    p, c = as_column(prev), as_column(cur)
    return F.struct(
        F.array_sort(F.array_except(c, p)).alias("added"), F.array_sort(F.array_except(p, c)).alias("removed"),
        F.array_sort(F.array_intersect(c, p)).alias("kept"))
