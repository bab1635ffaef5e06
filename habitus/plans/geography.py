"""Queries of the geography operators, on places and addresses derived from the sales and event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from habitus.functions import addresses as A, geo as G
from habitus.plans.ctes import with_
from habitus.plans.registry import query
from habitus.sources.locations import CITIES, STATES, location_registry
from habitus.sources.tables import event_stream_table, load, spread

PLACES = ("Ikeja, Lagos", "Benin City, Edo State", "Lafia 950101, Nasarawa", "Wuse, Abuja", "Somewhere, Kano", "Delta", "Nowhere, Atlantis", "-",
          "Port Harcourt., Rivers", "Ado Ekiti, Ekiti", "Zaria, Kaduna", "niger, minna", "Yola/North, Adamawa")
REG = "reg AS (SELECT * FROM (VALUES " + ", ".join(
    [f"('{n}', 'state', {la}::DOUBLE, {lo}::DOUBLE)" for n, (la, lo) in STATES.items()]
    + [f"('{n}', 'city', {la}::DOUBLE, {lo}::DOUBLE)" for n, (la, lo) in CITIES.items()]) + ") t(name, kind, lat, lon))"
PLACE_SQL = "[" + ", ".join(f"'{p}'" for p in PLACES) + "]"
PLACE_EXPR = "array(" + ", ".join(f"'{p}'" for p in PLACES) + ")"
# where each order line took place: a named place, the country, sometimes an address number
WHERE = f"concat(CASE WHEN l_linenumber = 1 THEN 'no 9 zafarawa street, ' ELSE '' END, place, CASE WHEN l_linenumber >= 5 THEN ', Nigeria' ELSE '' END)"
LOC = f"loc AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {WHERE} AS location FROM (SELECT *, {PLACE_SQL}[l_suppkey % {len(PLACES)} + 1] AS place FROM lineitem))"
KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
SEGS = """segs AS (SELECT *, CASE WHEN lower(trim(location)) IN ('', '-', '.', '..', '...', 'n/a', 'na', 'null', 'none', 'nil', 'unknown', 'nan') THEN NULL ELSE
  list_filter(list_transform(string_split(lower(replace(location, '/', ' ')), ','), lambda s: array_to_string(list_filter(list_transform(string_split(trim(s), ' '), lambda w: trim(w, '.')), lambda w: regexp_full_match(w, '[a-z]+')), ' ')),
  lambda s: s <> '' AND s NOT IN ('nigeria', 'ng', 'nga')) END AS sg FROM loc)"""
HIT = """hit AS (SELECT s.*, coalesce(c1.name, c2.name, s1.name, s2.name) AS loc_name, coalesce(c1.kind, c2.kind, s1.kind, s2.kind) AS loc_kind, coalesce(c1.lat, c2.lat, s1.lat, s2.lat) AS loc_lat, coalesce(c1.lon, c2.lon, s1.lon, s2.lon) AS loc_lon
  FROM (SELECT *, sg[-1] AS st, CASE WHEN len(sg) >= 2 THEN sg[-2] ELSE sg[-1] END AS ct FROM segs) s LEFT JOIN reg c1 ON c1.kind = 'city' AND c1.name = ct LEFT JOIN reg c2 ON c2.kind = 'city' AND c2.name = st
  LEFT JOIN reg s1 ON s1.kind = 'state' AND s1.name = st LEFT JOIN reg s2 ON s2.kind = 'state' AND s2.name = ct)"""


def places(spark, d):
    place = F.expr(f"element_at({PLACE_EXPR}, cast(l_suppkey % {len(PLACES)} + 1 AS int))")
    return spread(load(spark, d, "lineitem"), "l_orderkey").withColumn("place", place).select(*KEYS, F.expr(WHERE).alias("location"))


@query("j13_registry_lookup", with_(REG, LOC, SEGS, HIT) + "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, loc_name, loc_kind, loc_lat, loc_lon FROM hit")
def j13(spark, d):
    return G.registry_lookup(places(spark, d), location_registry(spark)).drop("location")


@query("x24_location_segments", with_(LOC, SEGS) + "SELECT location, any_value(sg IS NULL) AS is_placeholder, coalesce(any_value(array_to_string(sg, '|')), '') AS segments, count(*) AS n FROM segs GROUP BY 1")
def x24(spark, d):
    segs = F.when(G.is_placeholder("location"), "").otherwise(F.array_join(G.clean_segments("location"), "|"))
    return places(spark, d).groupBy("location").agg(F.count("*").alias("n")).select("location", G.is_placeholder("location").alias("is_placeholder"), segs.alias("segments"), "n")


IPS = "concat(l_partkey % 256, '.', l_suppkey % 256, '.', l_orderkey % 300, '.', l_linenumber)"


@query("x18_public_ip", with_(f"a AS (SELECT {IPS} AS ip, l_partkey % 256 AS a, l_suppkey % 256 AS b, l_orderkey % 300 AS c, l_linenumber AS e FROM lineitem)") + """SELECT ip, any_value(c <= 255 AND NOT (a IN (0, 10, 127) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254)
  OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 0 AND c = 0) OR (a = 192 AND b = 0 AND c = 2) OR (a = 192 AND b = 168) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100)
  OR (a = 203 AND b = 0 AND c = 113) OR a >= 224)) AS is_public, count(*) AS n FROM a GROUP BY ip""")
def x18(spark, d):
    return load(spark, d, "lineitem").groupBy(F.expr(IPS).alias("ip")).agg(F.count("*").alias("n")).select("ip", G.is_public_ip("ip").alias("is_public"), "n")


P1 = "(l_partkey * 17 % 18000) / 100e0 - 90"
O1 = "(l_orderkey * 13 % 36000) / 100e0 - 180"
P2 = "(l_suppkey * 29 % 18000) / 100e0 - 90"
O2 = "(l_orderkey * 7 % 36000) / 100e0 - 180"
HAV = f"6371.0088 * 2 * asin(least(1, sqrt(pow(sin((radians({P2}) - radians({P1})) / 2), 2) + cos(radians({P1})) * cos(radians({P2})) * pow(sin((radians({O2}) - radians({O1})) / 2), 2))))"


@query("x19_haversine", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({HAV}, 4) AS km FROM lineitem")
def x19(spark, d):
    km = G.haversine_km(*(F.expr(e) for e in (P1, O1, P2, O2)))
    return load(spark, d, "lineitem").select(*KEYS, F.round(km, 4).alias("km"))


@query("x20_geo_velocity", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(least(CASE WHEN l_linenumber > 1 THEN {HAV} / (l_linenumber - 1) ELSE 0 END, 9000), 3) AS kmh,
  round(ln(1 + least(CASE WHEN l_linenumber > 1 THEN {HAV} / (l_linenumber - 1) ELSE 0 END, 9000)), 6) AS feature FROM lineitem""")
def x20(spark, d):
    km = G.haversine_km(*(F.expr(e) for e in (P1, O1, P2, O2)))
    kmh = G.geo_velocity_kmh(km, F.col("l_linenumber") - 1.0, 9000.0)
    return load(spark, d, "lineitem").select(*KEYS, F.round(kmh, 3).alias("kmh"), F.round(F.log1p(kmh), 6).alias("feature"))


# full codes made from known digits: the check computes the centre from the digits, never from the text
AL = G.ALPHABET
DIG = {"a1": "l_partkey % 9", "o1": "l_suppkey % 18", "a2": "l_orderkey % 20", "o2": "l_linenumber % 20", "a3": "(l_orderkey + 3) % 20", "o3": "l_partkey % 20",
       "a4": "l_suppkey % 20", "o4": "(l_partkey + 7) % 20", "a5": "(l_orderkey * 3) % 20", "o5": "(l_suppkey * 7) % 20", "gr": "(l_partkey * 11) % 20"}


def letters(engine: str, names: list[str]) -> str:
    cast = "cast({} AS int)" if engine == "spark" else "CAST({} AS BIGINT)"
    return "concat(" + ", ".join(f"substr('{AL}', {cast.format(f'({DIG[n]}) + 1')}, 1)" for n in names) + ")"


HEAD, TAIL = ["a1", "o1", "a2", "o2", "a3", "o3", "a4", "o4"], ["a5", "o5"]


def code_text(engine: str) -> str:
    full, tail, grid = letters(engine, HEAD), letters(engine, TAIL), letters(engine, ["gr"])
    return f"concat('shop ', {full}, '+', {tail}, CASE WHEN l_linenumber = 7 THEN {grid} ELSE '' END, ', Lagos')"


LAT_D = "-90 + ({a1}) * 20.0::DOUBLE + ({a2}) + ({a3}) / 20.0::DOUBLE + ({a4}) / 400.0::DOUBLE + ({a5}) / 8000.0::DOUBLE".format(**DIG)
LON_D = "-180 + ({o1}) * 20.0::DOUBLE + ({o2}) + ({o3}) / 20.0::DOUBLE + ({o4}) / 400.0::DOUBLE + ({o5}) / 8000.0::DOUBLE".format(**DIG)


@query("x23_plus_codes", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  round({LAT_D} + CASE WHEN l_linenumber = 7 THEN (({DIG['gr']}) // 4) / 40000.0::DOUBLE + 1 / 80000.0::DOUBLE ELSE 1 / 16000.0::DOUBLE END, 7) AS lat,
  round({LON_D} + CASE WHEN l_linenumber = 7 THEN (({DIG['gr']}) % 4) / 32000.0::DOUBLE + 1 / 64000.0::DOUBLE ELSE 1 / 16000.0::DOUBLE END, 7) AS lon FROM lineitem""")
def x23(spark, d):
    df = load(spark, d, "lineitem").select(*KEYS, F.expr(code_text("spark")).alias("text"))
    return G.resolve_plus_codes(df, "text").select(*KEYS, F.round("pc_lat", 7).alias("lat"), F.round("pc_lon", 7).alias("lon"))


@query("x23_short_plus_codes", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({LAT_D} + 1 / 16000.0::DOUBLE, 7) AS lat, round({LON_D} + 1 / 16000.0::DOUBLE, 7) AS lon FROM lineitem""")
def x23_short(spark, d):
    """Drop the first four digits and recover them from a point within 0.4 degrees of the true centre."""
    short = f"concat({letters('spark', HEAD[4:])}, '+', {letters('spark', TAIL)})"
    near = {"ref_lat": F.expr(LAT_D.replace("::DOUBLE", "D")) + F.expr("(l_partkey % 80 - 40) / 100e0"),
            "ref_lon": F.expr(LON_D.replace("::DOUBLE", "D")) + F.expr("(l_suppkey % 80 - 40) / 100e0")}
    df = load(spark, d, "lineitem").select(*KEYS, F.expr(short).alias("text"), *[c.alias(n) for n, c in near.items()])
    return G.resolve_plus_codes(df, "text", "ref_lat", "ref_lon").select(*KEYS, F.round("pc_lat", 7).alias("lat"), F.round("pc_lon", 7).alias("lon"))


WATER = with_(REG, LOC, SEGS, HIT) + f""", w AS (SELECT *, CASE WHEN l_linenumber = 2 THEN CASE WHEN l_suppkey % 7 = 0 THEN 95.0 ELSE 9.5 END END AS latitude, CASE WHEN l_linenumber = 2 THEN 7.25 END AS longitude,
  CASE WHEN l_linenumber = 3 THEN '10.0.0.1' WHEN l_linenumber = 4 THEN '41.58.1.9' WHEN l_linenumber = 5 THEN '2c0f:f248::1' END AS ip, {LAT_D} + 1 / 16000.0::DOUBLE AS code_lat FROM hit),
src AS (SELECT *, CASE WHEN latitude BETWEEN -90 AND 90 THEN 'coordinates' WHEN l_linenumber = 6 THEN 'plus_code' WHEN loc_lat IS NOT NULL THEN 'location_registry' WHEN l_linenumber IN (4, 5) THEN 'ip' ELSE 'unavailable' END AS s FROM w)"""


@query("x21_coordinate_waterfall", WATER + """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, s AS geo_source,
  round(CASE s WHEN 'coordinates' THEN latitude WHEN 'plus_code' THEN code_lat WHEN 'location_registry' THEN loc_lat WHEN 'ip' THEN CASE l_linenumber WHEN 4 THEN 6.5 ELSE -1.25 END END, 7) AS geo_lat,
  CASE s WHEN 'coordinates' THEN 'exact' WHEN 'plus_code' THEN 'plus_code' WHEN 'location_registry' THEN loc_kind WHEN 'ip' THEN 'ip' END AS geo_granularity,
  CASE s WHEN 'coordinates' THEN 0 WHEN 'plus_code' THEN 13.9 WHEN 'location_registry' THEN CASE loc_kind WHEN 'city' THEN 8000 ELSE 60000 END END AS geo_precision_m,
  CASE WHEN s = 'unavailable' THEN CASE WHEN sg IS NOT NULL THEN 'unknown_location' WHEN ip = '10.0.0.1' THEN 'private_or_malformed_ip' ELSE 'no_evidence' END END AS unresolved_reason FROM src""")
def x21(spark, d):
    return resolved(spark, d).select(*KEYS, "geo_source", F.round("geo_lat", 7).alias("geo_lat"), "geo_granularity", "geo_precision_m", "unresolved_reason")


#: Address blocks of the waterfall's rows: a country with a city inside it, and one of the other family.
BLOCKS = [("41.0.0.0/8", 0.5, 0.5), ("41.58.0.0/16", 6.5, 3.4), ("2c0f:f248::/32", -1.25, 36.75)]


def resolved(spark, d):
    rows = places(spark, d).withColumns({
        "latitude": F.expr("CASE WHEN l_linenumber = 2 THEN CASE WHEN l_suppkey % 7 = 0 THEN 95D ELSE 9.5D END END"),
        "longitude": F.expr("CASE WHEN l_linenumber = 2 THEN 7.25D END"),
        "ip": F.expr("CASE WHEN l_linenumber = 3 THEN '10.0.0.1' WHEN l_linenumber = 4 THEN '41.58.1.9' WHEN l_linenumber = 5 THEN '2c0f:f248::1' END"),
        "location": F.when(F.col("l_linenumber") == 6, F.expr(code_text("spark"))).otherwise(F.col("location"))})
    blocks = A.ranges_of(spark.createDataFrame(BLOCKS, "network string, lat double, lon double"), network="network")
    return G.resolve_coords(rows, location_registry(spark), A.range_resolver(blocks))


# visits come from IPv4 addresses and, one in five, IPv6 ones; each supplier has a range of either family, and they overlap
RANGES = """v AS (SELECT event_id, event_id % 5 = 0 AS six, CASE WHEN event_id % 5 = 0 THEN (user_id % 8) * 65536 + event_id * 7 % 65536
  ELSE 41 * 16777216 + (user_id % 4) * 65536 + (event_id % 256) * 256 + event_id * 7 % 256 END AS n FROM events),
r AS (SELECT s_suppkey, s_suppkey % 3 = 0 AS six, CASE WHEN s_suppkey % 3 = 0 THEN (s_suppkey % 8) * 65536 + s_suppkey * 53 % 65536
  ELSE 41 * 16777216 + (s_suppkey % 4) * 65536 + (s_suppkey * 37 % 256) * 256 + s_suppkey * 11 % 256 END AS lo, s_suppkey * s_suppkey % 5000 AS size FROM supplier)"""
TEXT = """CASE WHEN six THEN concat('2c0f:', lower(hex({n} DIV 65536)), '::', lower(hex({n} % 65536)))
  ELSE concat_ws('.', {n} DIV 16777216, {n} DIV 65536 % 256, {n} DIV 256 % 256, {n} % 256) END"""


@query("x21_address_ranges", with_(RANGES) + """SELECT event_id, s_suppkey, count_in::BIGINT AS ranges_around FROM (SELECT v.event_id, r.s_suppkey, count(r.s_suppkey) OVER (PARTITION BY v.event_id) AS count_in,
  row_number() OVER (PARTITION BY v.event_id ORDER BY lo DESC, hi, s_suppkey) AS k FROM v LEFT JOIN (SELECT *, CASE WHEN six THEN least(lo + size, lo // 65536 * 65536 + 65535) ELSE lo + size END AS hi FROM r) r
  ON v.six = r.six AND v.n BETWEEN r.lo AND r.hi) WHERE k = 1""")
def x21_address_ranges(spark, d):
    text = lambda n, name: F.expr(TEXT.format(n=n)).alias(name)
    visits = load(spark, d, "events").select("event_id", F.expr("event_id % 5 = 0").alias("six"), F.expr(
        "CASE WHEN event_id % 5 = 0 THEN (user_id % 8) * 65536 + event_id * 7 % 65536 ELSE 41 * 16777216 + (user_id % 4) * 65536 + (event_id % 256) * 256 + event_id * 7 % 256 END").alias("n"))
    lo = F.expr("CASE WHEN s_suppkey % 3 = 0 THEN (s_suppkey % 8) * 65536 + s_suppkey * 53 % 65536 ELSE 41 * 16777216 + (s_suppkey % 4) * 65536 + (s_suppkey * 37 % 256) * 256 + s_suppkey * 11 % 256 END")
    owned = load(spark, d, "supplier").select("s_suppkey", F.expr("s_suppkey % 3 = 0").alias("six"), lo.alias("lo")).withColumn("far", F.expr("lo + s_suppkey * s_suppkey % 5000"))
    owned = owned.withColumn("hi", F.expr("CASE WHEN six THEN least(far, lo DIV 65536 * 65536 + 65535) ELSE far END"))
    ranges = A.ranges_of(owned.select("s_suppkey", text("lo", "first"), text("hi", "last")))
    return A.with_ranges(visits.select("event_id", text("n", "ip")), ranges, "ip", ("s_suppkey",), around="ranges_around").drop("ip")


POINT = "pts AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS customer_key, epoch_us(ts) AS us, CASE WHEN event_type <> 'error' THEN value / 10 END AS lat, CASE WHEN event_type <> 'error' THEN value / 5 END AS lon FROM events)"
PREV = "prv AS (SELECT *, lag(CASE WHEN lat IS NOT NULL THEN {'us': us, 'lat': lat, 'lon': lon} END IGNORE NULLS) OVER (PARTITION BY customer_key ORDER BY us, id) AS p FROM pts)"
KM = "6371.0088 * 2 * asin(least(1, sqrt(pow(sin((radians(lat) - radians(p.lat)) / 2), 2) + cos(radians(p.lat)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(p.lon)) / 2), 2))))"


def geo_points(spark, d):
    from habitus.streaming.points import event_points
    return event_points(event_stream_table(spark, d))


@query("w07_previous_point", with_(POINT, PREV) + f"""SELECT id, CASE WHEN us - p.us <= 12 * 3600000000 THEN us - p.us END AS gap_us,
  round(CASE WHEN us - p.us <= 12 * 3600000000 AND lat IS NOT NULL THEN CASE WHEN us > p.us AND lat BETWEEN -90 AND 90 AND p.lat BETWEEN -90 AND 90 THEN {KM} / ((us - p.us) / 3.6e9::DOUBLE) ELSE 0 END END, 3) AS kmh FROM prv""")
def w07(spark, d):
    from habitus.streaming.points import with_geo_velocity
    return with_geo_velocity(geo_points(spark, d), retain_hours=12).select("id", (F.unix_micros("ts") - F.col("prev_us")).alias("gap_us"), F.round("kmh", 3).alias("kmh"))
