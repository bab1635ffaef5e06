"""Addresses of both families: keys and public ones against the standard library, ranges cut to prefixes, lookups, hooks."""

import ipaddress
import random

from pyspark.sql import functions as F

from habitus.functions import addresses as A, geo as G
from habitus.sources.locations import location_registry


def key_of(text):
    a = ipaddress.ip_address(text.partition("%")[0])
    return a.packed.hex().rjust(32, "0") if a.version == 6 else A.MAPPED + a.packed.hex()


def samples():
    rng = random.Random(2)
    four = [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(150)]
    six = []
    for _ in range(150):
        groups = [rng.choice([0, 0, 0, 1, rng.getrandbits(16)]) for _ in range(8)]
        a = ipaddress.IPv6Address(sum(g << 16 * (7 - i) for i, g in enumerate(groups)))
        six += [str(a), a.exploded, str(a).upper()]
    edges = [str(e) for n in A.RESERVED + A.ROUTABLE for net in [ipaddress.ip_network(n)] for e in (
        net.network_address, net.broadcast_address, *(x + d for x, d in ((net.network_address, -1), (net.broadcast_address, 1)) if 0 < int(x) < 2**net.max_prefixlen - 1))]
    return four + six + edges + ["::", "::1", "1::", "::ffff:8.8.8.8", "::ffff:10.0.0.1", "64:ff9b::1.2.3.4", "fe80::1%eth0", "2001:4860:4860::8888", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8"]


def test_keys_and_public_addresses_against_the_standard_library(spark):
    texts = samples()
    for r in spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", A.ip_key("ip").alias("k"), A.is_public_ip("ip").alias("p")).collect():
        a = ipaddress.ip_address(r.ip)
        assert r.k == key_of(r.ip), r.ip
        assert r.p == (a.is_global and not a.is_multicast), r.ip


def test_malformed_addresses(spark):
    bad = ["", " ", ":", ":::", "1:2", "1:2:3:4:5:6:7:8:9", "1::2::3", "12345::", "g::1", "1:2:3:4:5:6:7:8::", "::1.2.3", "::1.2.3.400", "1.2.3.4::", "1:", ":1", "::1%", "%1", "a.b.c.d", "01.2.3.4", "1.2.3.4:5", None]
    rows = spark.createDataFrame([(t,) for t in bad], "ip string").select("ip", A.ip_key("ip").alias("k"), A.is_public_ip("ip").alias("p")).collect()
    assert [(r.ip, r.k, r.p) for r in rows if r.k is not None or r.p] == []


def test_ranges_become_the_least_prefixes(spark):
    rng = random.Random(6)
    pairs = []
    for bits, make in ((32, ipaddress.IPv4Address), (128, ipaddress.IPv6Address)):
        for _ in range(60):
            a, b = sorted(rng.getrandbits(bits) >> rng.randrange(bits) << rng.randrange(3) & (1 << bits) - 1 for _ in range(2))
            pairs.append((make(a), make(b)))
        pairs += [(make(0), make(2**bits - 1)), (make(5), make(5)), (make(4), make(7)), (make(0), make(0))]
    rows = spark.createDataFrame([(i, str(a), str(b)) for i, (a, b) in enumerate(pairs)], "i int, first string, last string")
    for r in A.ranges_of(rows).select("i", A.range_prefixes(F.col("first_key"), F.col("last_key")).alias("p")).collect():
        a, b = pairs[r.i]
        full = f"{int(key_of(str(a))[:24], 16):096b}" if a.version == 4 else ""
        want = sorted(full + f"{int(n.network_address):0{n.max_prefixlen}b}"[:n.prefixlen] for n in ipaddress.summarize_address_range(a, b))
        assert sorted(r.p) == want, pairs[r.i]
    back = A.ranges_of(spark.createDataFrame([("9.9.9.9", "1.1.1.1")], "first string, last string"))
    assert back.select(F.size(A.range_prefixes(F.col("first_key"), F.col("last_key")))).first()[0] == 0


def test_prefix_notation(spark):
    texts = ["41.58.0.0/16", "41.58.3.4/16", "10.0.0.1", "2c0f:f248::/32", "::/0", "::1", "1.2.3.4/33", "x/8", "1.2.3.4/-1", None]
    got = {r.n: (r.first_key, r.last_key) for r in A.ranges_of(spark.createDataFrame([(t,) for t in texts], "n string"), network="n").collect()}
    want = {t: ipaddress.ip_network(t, strict=False) for t in texts[:6]}
    assert got == {t: (key_of(str(n[0])), key_of(str(n[-1]))) for t, n in want.items()}


def test_lookup_prefers_the_innermost_range_without_a_nested_loop(spark):
    ranges = A.ranges_of(spark.createDataFrame([
        ("41.0.0.0", "41.255.255.255", 1), ("41.58.0.0", "41.58.255.255", 2), ("41.58.1.3", "41.58.1.90", 3), ("41.58.1.80", "41.58.1.99", 4), ("41.58.1.80", "41.58.1.99", 5),
        ("2c0f::", "2c0f:ffff:ffff:ffff:ffff:ffff:ffff:ffff", 6), ("bad", "41.1.1.1", 7), ("2.0.0.0", "1.0.0.0", 8)], "first string, last string, who int"))
    asked = [("41.58.1.5", 3, 3), ("41.58.1.85", 4, 5), ("41.58.1.2", 2, 2), ("41.1.1.1", 1, 1), ("8.8.8.8", None, 0), ("2c0f:0001::9", 6, 1), ("::ffff:41.58.1.5", 3, 3), ("1.5.0.0", None, 0), ("x", None, 0), (None, None, 0)]
    df = spark.createDataFrame([(a[0], i) for i, a in enumerate(asked)] * 2, "ip string, i int")
    out = A.with_ranges(df, ranges, "ip", ("who",), around="n")
    assert {(r.i, r.who, r.n) for r in out.collect()} == {(i, w, n) for i, (_, w, n) in enumerate(asked)}
    assert out.count() == len(asked) * 2 and out.columns == ["ip", "i", "who", "n"]
    assert not any(w in out._jdf.queryExecution().executedPlan().toString() for w in ("NestedLoop", "Cartesian"))
    assert A.with_ranges(df, ranges.where("false"), "ip", ("who",)).where("who IS NOT NULL").count() == 0


def test_hooks_of_the_waterfall(spark):
    rows = [(1, None, None, "Lagos", "41.58.1.9"), (2, None, None, "Atlantis", "41.58.1.9"), (3, None, None, "Atlantis", "10.0.0.1"), (4, None, None, " ", "2c0f:f248::1"), (5, 6.0, 3.0, "Depot", None), (6, None, None, "Depot", "41.58.1.9")]
    df = spark.createDataFrame(rows, "i int, latitude double, longitude double, location string, ip string")
    blocks = A.ranges_of(spark.createDataFrame([("41.58.0.0/16", 6.5, 3.4), ("10.0.0.0/8", 9.0, 9.0), ("2c0f:f248::/32", 95.0, 0.0)], "network string, lat double, lon double"), network="network")

    def depots(d):
        return d.withColumns({"hook_lat": F.when(F.col("location") == "Depot", 1.5).when(F.col("location") == "Atlantis", 91.0), "hook_lon": F.lit(2.5)})

    out = {r.i: (r.geo_source, r.geo_lat, r.geo_granularity, r.geo_precision_m, r.unresolved_reason) for r in G.resolve_coords(df, location_registry(spark), A.range_resolver(blocks)).collect()}
    assert out[1][0] == "location_registry" and out[1][3] == 8000.0 and out[2] == ("ip", 6.5, "ip", None, None)
    assert out[3] == ("unavailable", None, None, None, "unknown_location") and out[4] == ("unavailable", None, None, None, "no_evidence") and out[5][0] == "coordinates"
    hooked = {r.i: (r.geo_source, r.geo_lat, r.geo_granularity, r.geo_precision_m) for r in G.resolve_coords(df, location_registry(spark), A.range_resolver(blocks), depots).collect()}
    assert hooked[6] == ("location_registry", 1.5, "hook", None) and hooked[1] == hooked[2] == ("ip", 6.5, "ip", None)
