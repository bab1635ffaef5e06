"""Geography: public addresses, distances, speeds, location text, Plus Codes and the coordinate waterfall."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from habitus.functions.addresses import is_public_ip
from habitus.functions.normalize import as_column
from habitus.sources.locations import COUNTRY_TOKENS, PLACEHOLDERS

# Fixed value: mean Earth radius in kilometres.
EARTH_KM = 6371.0088


def valid_point(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; 0 when a point is missing or out of range."""
    a1, o1, a2, o2 = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), F.lit(2.0)) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), F.lit(2.0))
    km = EARTH_KM * 2.0 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))
    return F.when(valid_point(lat1, lon1) & valid_point(lat2, lon2), km).otherwise(0.0)


def geo_velocity_kmh(km: Column, hours: Column, cap: float = 0.0) -> Column:
    """Speed between two points; 0 when time did not pass, optionally capped."""
    speed = F.when(F.coalesce(hours, F.lit(0.0)) > 0, km / hours).otherwise(0.0)
    return F.least(speed, F.lit(cap)) if cap > 0 else speed


def is_placeholder(c: Column | str) -> Column:
    """Missing location text, or text that stands for it."""
    return F.coalesce(F.lower(F.trim(as_column(c))).isin(*PLACEHOLDERS), F.lit(True))


def clean_segment(seg: Column) -> Column:
    """Alphabetic words of one comma segment (postcodes, codes and house numbers drop out)."""
    words = F.split(F.regexp_replace(F.lower(seg), "/", " "), r"\s+")
    words = F.transform(words, lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))
    return F.array_join(F.filter(words, lambda w: w.rlike(r"^-*\p{L}[\p{L}-]*$")), " ")


def clean_segments(c: Column | str) -> Column:
    """Cleaned, non-blank comma segments that do not just name the country."""
    segments = F.transform(F.split(as_column(c), ","), clean_segment)
    return F.filter(segments, lambda s: (s != "") & ~s.isin(*COUNTRY_TOKENS))


def registry_lookup(df: DataFrame, registry: DataFrame, col: str = "location") -> DataFrame:
    """Add `loc_lat`, `loc_lon`, `loc_name`, `loc_kind` from the registry; null without an exact match.

    Candidates in order: last-but-one segment as a city, last segment as a city, last segment as a state,
    last-but-one as a state. The registry has one row per (name, kind) and a fixed small size, so it becomes one map.
    """
    pairs = registry.agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat_ws("|", "kind", "name"), F.struct("lat", "lon", "name", "kind")))).alias("m"))
    df = df.withColumns({"_reg": pairs.scalar(), "_segs": F.when(~is_placeholder(col), clean_segments(col))})
    last = F.try_element_at("_segs", F.lit(-1))
    city = F.coalesce(F.try_element_at("_segs", F.lit(-2)), last)

    def entry(kind: str, name: Column) -> Column:
        return F.try_element_at("_reg", F.concat(F.lit(f"{kind}|"), name))

    hit = F.coalesce(entry("city", city), entry("city", last), entry("state", last), entry("state", city))
    return df.withColumn("_hit", hit).withColumns({
        f"loc_{n}": F.col(f"_hit.{n}") for n in ("lat", "lon", "name", "kind")}).drop("_reg", "_segs", "_hit")


# The Open Location Code alphabet and geometry.
ALPHABET = "23456789CFGHJMPQRVWX"
CELLS = 8000.0  # code cells per degree at ten digits
GRID_ROWS, GRID_COLS = 5, 4
TOKEN = rf"\b([{ALPHABET}0]{{2,8}}\+[{ALPHABET}]{{0,7}})\b"
VALID = rf"^((([{ALPHABET}]{{2}}){{1,4}}\+([{ALPHABET}]{{2,7}})?)|([{ALPHABET}]{{2}}0{{6}}\+)|([{ALPHABET}]{{4}}0{{4}}\+)|([{ALPHABET}]{{6}}00\+))$"


def extract_plus_code(c: Column | str) -> Column:
    """The first Plus Code in a text, upper-cased; null when there is none or it is malformed."""
    token = F.nullif(F.regexp_extract(F.upper(as_column(c)), TOKEN, 1), F.lit(""))
    return F.when(token.rlike(VALID), token)


def digit_values(digits: Column) -> Column:
    """The value of every code digit, in order."""
    return F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.instr(F.lit(ALPHABET), F.substring(digits, i, F.lit(1))) - 1)


def decode_digits(values: Column) -> dict[str, Column]:
    """South-west corner and cell size of a full code, from the array of its digit values."""
    def at(i: int) -> Column:
        return F.get(values, F.lit(i))

    lat, lon = F.lit(-90.0 * CELLS), F.lit(-180.0 * CELLS)
    for pair in range(5):
        worth = float(20 ** (4 - pair))
        lat, lon = lat + F.coalesce(at(2 * pair) * worth, F.lit(0.0)), lon + F.coalesce(at(2 * pair + 1) * worth, F.lit(0.0))
    pairs = F.least(F.floor(F.size(values) / 2), F.lit(5))
    size = F.pow(F.lit(20.0), (F.lit(5) - pairs).cast("double")) / CELLS
    lat, lon = lat / CELLS, lon / CELLS
    lat_size, lon_size = size, size
    for step in range(1, 6):
        d = at(9 + step)
        high, wide = CELLS * GRID_ROWS**step, CELLS * GRID_COLS**step
        lat = lat + F.coalesce(F.floor(d / GRID_COLS) / high, F.lit(0.0))
        lon = lon + F.coalesce((d % GRID_COLS) / wide, F.lit(0.0))
        lat_size, lon_size = F.when(d.isNotNull(), 1.0 / high).otherwise(lat_size), F.when(d.isNotNull(), 1.0 / wide).otherwise(lon_size)
    return {"lat": lat, "lon": lon, "lat_size": lat_size, "lon_size": lon_size}


def reference_digits(lat: Column, lon: Column) -> Column:
    """Ten code digits of a reference point."""
    a = F.floor((F.least(F.greatest(lat, F.lit(-90.0)), F.lit(90.0 - 1e-9)) + 90.0) * CELLS)
    o = F.floor(F.pmod(lon + 180.0, F.lit(360.0)) * CELLS)

    def letter(v: Column, worth: Column) -> Column:
        return F.substring(F.lit(ALPHABET), (F.floor(v / worth) % 20 + 1).cast("int"), F.lit(1))

    worths = F.array(*[F.lit(float(20**place)) for place in (4, 3, 2, 1, 0)])
    digits = F.array_join(F.transform(worths, lambda w: F.concat(letter(a, w), letter(o, w))), "")
    return F.when(lat.isNotNull() & lon.isNotNull(), digits)


def resolve_plus_codes(df: DataFrame, col: str, ref_lat: str | None = None, ref_lon: str | None = None) -> DataFrame:
    """Add `plus_code`, `pc_lat`, `pc_lon`, `pc_precision_m`.

    Full codes decode alone. Short codes take their missing leading digits from the reference point and move by one
    step when that brings them nearer; without a reference they stay unresolved.
    """
    code = extract_plus_code(col)
    df = df.withColumn("plus_code", code)
    lead = F.instr(F.col("plus_code"), "+") - 1
    missing = F.lit(8) - lead
    plain = F.regexp_replace(F.regexp_replace("plus_code", r"\+", ""), "0+$", "")
    rlat = F.col(ref_lat) if ref_lat else F.lit(None).cast("double")
    rlon = F.col(ref_lon) if ref_lon else F.lit(None).cast("double")
    short = missing > 0
    prefix = F.substring(reference_digits(rlat, rlon), F.lit(1), missing)
    df = df.withColumns({"_digits": F.when(short, F.concat(prefix, plain)).otherwise(plain), "_short": short, "_step": F.pow(F.lit(20.0), 2.0 - missing / 2.0)})
    df = df.withColumn("_values", digit_values(F.col("_digits")))
    area = decode_digits(F.col("_values"))
    known = F.col("_digits").isNotNull()
    centre = {"_lat": area["lat"] + area["lat_size"] / 2, "_lon": area["lon"] + area["lon_size"] / 2, "_h": area["lat_size"], "_w": area["lon_size"]}
    df = df.withColumns({n: F.when(known, c) for n, c in centre.items()})
    half = F.col("_step") / 2

    def nearer(c: str, ref: Column, bound: float | None) -> Column:
        down, up = F.col(c) - F.col("_step"), F.col(c) + F.col("_step")
        low, high = (down >= -bound, up <= bound) if bound else (F.lit(True), F.lit(True))
        moved = F.when((ref + half < F.col(c)) & low, down).when((ref - half > F.col(c)) & high, up).otherwise(F.col(c))
        return F.when(F.col("_short"), moved).otherwise(F.col(c))

    lat = nearer("_lat", rlat, 90.0)
    lon = F.pmod(nearer("_lon", rlon, None) + 180.0, F.lit(360.0)) - 180.0
    across = F.col("_w") * 111_320.0 * F.greatest(F.lit(0.1), F.cos(F.radians(lat)))
    return df.withColumns({
        "pc_lat": lat, "pc_lon": lon, "pc_precision_m": F.when(lat.isNotNull(), F.greatest(F.col("_h") * 111_320.0, across)),
    }).drop("_digits", "_values", "_short", "_step", "_lat", "_lon", "_h", "_w")


Hook = Callable[[DataFrame], DataFrame]


def resolve_coords(df: DataFrame, registry: DataFrame, resolver: Hook | None = None, locations: Hook | None = None) -> DataFrame:
    """Coordinates by falling quality: explicit, Plus Code, registry, address resolver, none.

    Reads `latitude`, `longitude`, `location`, `ip`; adds geo_lat, geo_lon, geo_source, geo_granularity, geo_precision_m,
    the evidence flags and, when nothing resolves, a reason. `resolver` is a user hook that adds `ip_lat`, `ip_lon`, such as
    addresses.range_resolver; it counts for public addresses only. `locations` is a hook that adds `hook_lat`, `hook_lon` from
    `location`; with one the registry only helps short Plus Codes. Points out of range count as not found.
    """
    out = resolver(df) if resolver else df.withColumns({c: F.lit(None).cast("double") for c in ("ip_lat", "ip_lon")})  # rows are narrow here
    out = resolve_plus_codes(registry_lookup(out, registry), "location", "loc_lat", "loc_lon")
    if locations:
        named = F.coalesce(F.trim("location") != "", F.lit(False)) & valid_point(F.col("hook_lat"), F.col("hook_lon"))
        out = locations(out).withColumns({"loc_lat": F.when(named, F.col("hook_lat")), "loc_lon": F.when(named, F.col("hook_lon")), "loc_kind": F.when(named, "hook")}).drop("hook_lat", "hook_lon")
    explicit, public = valid_point(F.col("latitude"), F.col("longitude")), F.col("ip_public")
    out = out.withColumn("ip_public", is_public_ip("ip"))
    by_ip = public & valid_point(F.col("ip_lat"), F.col("ip_lon"))
    source = (
        F.when(explicit, "coordinates").when(F.col("pc_lat").isNotNull(), "plus_code").when(F.col("loc_lat").isNotNull(), "location_registry")
        .when(by_ip, "ip").otherwise("unavailable"))
    out = out.withColumns({
        "geo_source": source, "plus_code_present": F.col("plus_code").isNotNull(), "loc_present": ~is_placeholder("location"),
        "ip_present": F.coalesce(F.col("ip") != "", F.lit(False))})
    src = F.col("geo_source")

    def pick(options: dict[str, Column]) -> Column:
        return reduce(lambda acc, kv: F.when(src == kv[0], kv[1]).otherwise(acc), options.items(), F.lit(None))

    registry_m = F.when(F.col("loc_kind") == "city", 8000.0).when(F.col("loc_kind") == "state", 60000.0)
    out = out.withColumns({
        "geo_lat": pick({"coordinates": F.col("latitude"), "plus_code": F.col("pc_lat"), "location_registry": F.col("loc_lat"), "ip": F.col("ip_lat")}),
        "geo_lon": pick({"coordinates": F.col("longitude"), "plus_code": F.col("pc_lon"), "location_registry": F.col("loc_lon"), "ip": F.col("ip_lon")}),
        "geo_granularity": pick({"coordinates": F.lit("exact"), "plus_code": F.lit("plus_code"), "location_registry": F.col("loc_kind"), "ip": F.lit("ip")}),
        "geo_precision_m": pick({"coordinates": F.lit(0.0), "plus_code": F.round("pc_precision_m", 1), "location_registry": registry_m}),
        "plus_code_decoded": src == "plus_code", "loc_resolved": src.isin("plus_code", "location_registry"), "ip_resolved": src == "ip",
        "unresolved_reason": F.when(src == "unavailable", F.when(F.col("loc_present"), "unknown_location").when(
            F.col("ip_present") & ~F.col("ip_public"), "private_or_malformed_ip").otherwise("no_evidence")),
    })
    return out.drop("loc_lat", "loc_lon", "loc_name", "loc_kind", "plus_code", "pc_lat", "pc_lon", "pc_precision_m", "ip_lat", "ip_lon")
