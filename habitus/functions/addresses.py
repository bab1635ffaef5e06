"""Internet addresses of both families as keys of 32 hexadecimal digits, public ones, and ranges cut to prefixes.

An IPv4 address is keyed by the IPv6 address that maps it, so one order and one table of ranges serve both families.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from habitus.functions.normalize import as_column
from habitus.operators.salted import salted_join

# Networks that are not globally routable, those inside them that are, and multicast.
RESERVED = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
    "::/128", "::1/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10", "ff00::/8",
)
ROUTABLE = ("192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
MAPPED = "0" * 20 + "ffff"
BITS = 128


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, so that long expressions stay small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ip_number(c: Column | str) -> Column:
    """A well-formed IPv4 address as a number; null for anything else."""
    def number(ip: Column) -> Column:
        octets = F.transform(F.split(ip, r"\."), lambda p: p.try_cast("long"))
        value = F.when(F.forall(octets, lambda o: o <= 255), F.aggregate(octets, F.lit(0).cast("long"), lambda acc, o: acc * 256 + o))
        return F.when(ip.rlike(r"^(0|[1-9]\d{0,2})(\.(0|[1-9]\d{0,2})){3}$"), value)

    return let(F.trim(as_column(c)), number)


def _groups(side: Column) -> Column:
    return F.filter(F.split(side, ":"), lambda g: g != "")


def ip6_key(c: Column | str) -> Column:
    """A well-formed IPv6 address as 32 hexadecimal digits, a zone left out; null for anything else."""
    def plain(text: Column) -> Column:
        tail = ip_number(F.regexp_extract(text, r":([0-9.]+)$", 1))  # the last four bytes may be written as IPv4
        low = let(tail, lambda n: F.concat(F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(F.lit(65535))))))
        return F.when(F.contains(text, F.lit(".")), F.concat(F.regexp_extract(text, r"^(.*:)[0-9.]+$", 1), low)).otherwise(text)

    def key(t: Column) -> Column:
        sides = F.split(t, "::", -1)
        formed = F.forall(sides, lambda s: s.rlike("^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?$"))
        left, right = _groups(F.get(sides, F.lit(0))), _groups(F.get(sides, F.lit(1)))
        short = F.lit(8) - F.size(left) - F.size(right)
        full = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(short, F.lit(0))), right)
        digits = lambda groups: F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")
        return F.when(formed & (F.size(sides) == 1) & (F.size(left) == 8), digits(left)).when(formed & (F.size(sides) == 2) & (short >= 1), digits(full))

    return let(let(F.regexp_replace(F.lower(F.trim(as_column(c))), "(?<=.)%[^%]+$", ""), plain), key)


def ip_key(c: Column | str) -> Column:
    """An address of either family as 32 hexadecimal digits that order as addresses do; null for malformed text."""
    four = lambda n: F.concat(F.lit(MAPPED), F.lower(F.lpad(F.hex(n), 8, "0")))
    return let(as_column(c), lambda a: F.coalesce(let(ip_number(a), lambda n: F.when(n.isNotNull(), four(n))), F.when(F.contains(a, F.lit(":")), ip6_key(a))))


def network_keys(network: str) -> tuple[str, str]:
    """First and last key of a network in prefix notation."""
    net = ipaddress.ip_network(network)
    text = lambda a: (MAPPED if net.version == 4 else "") + a.packed.hex()
    return text(net.network_address), text(net.broadcast_address)


def is_public_ip(c: Column | str) -> Column:
    """True only for a well-formed, globally routable address that is no multicast address; never null."""
    def open_to_all(key: Column, six: bool, end: Callable[[str], object]) -> Column:
        def within(networks: tuple[str, ...]) -> Column:
            return reduce(lambda a, b: a | b, [key.between(*map(end, network_keys(n))) for n in networks if (":" in n) == six])

        return ~within(RESERVED) | within(ROUTABLE)

    def judged(k: Column) -> Column:
        four = let(F.conv(F.right(k, F.lit(8)), 16, 10).cast("long"), lambda n: open_to_all(n, False, lambda e: int(e[-8:], 16)))
        return F.when(F.startswith(k, F.lit(MAPPED)), four).otherwise(open_to_all(k, True, str))

    return F.coalesce(let(ip_key(c), judged), F.lit(False))


def bits(key: Column) -> Column:
    """A key as text of 128 binary digits."""
    return F.array_join(F.transform(F.filter(F.split(key, ""), lambda d: d != ""), lambda d: F.lpad(F.conv(d, 16, 2), 4, "0")), "")


def range_prefixes(first: Column, last: Column) -> Column:
    """The least set of prefixes, as binary text, that cover exactly the addresses from key first to key last, 254 at most;
    none if first is after last."""
    def cover(lo: Column, hi: Column) -> Column:
        places = F.sequence(F.lit(1), F.lit(BITS))
        digit = lambda s, i: F.substring(s, i, F.lit(1))
        # the first place where the two differ, and where the rest of the range's ends is all the way to the block's edge
        fork = F.coalesce(F.get(F.filter(places, lambda i: digit(lo, i) != digit(hi, i)), F.lit(0)), F.lit(BITS + 1))
        a, b = F.length(F.rtrim(lo, F.lit("0"))), F.length(F.rtrim(hi, F.lit("1")))

        def sides(at: Column) -> Column:
            low, high = F.greatest(at, a), F.greatest(at, b)
            up = F.transform(F.filter(places, lambda i: (i > at) & (i < low) & (digit(lo, i) == "0")), lambda i: F.concat(F.left(lo, i - 1), F.lit("1")))
            down = F.transform(F.filter(places, lambda i: (i > at) & (i < high) & (digit(hi, i) == "1")), lambda i: F.concat(F.left(hi, i - 1), F.lit("0")))
            one = F.array(F.left(lo, at - 1))
            return F.when((a < at) & (b < at), one).otherwise(F.concat(F.array(F.left(lo, low)), up, down, F.array(F.left(hi, high))))

        return F.when(lo == hi, F.array(lo)).otherwise(let(fork, sides))

    ends = let(F.struct(bits(first).alias("lo"), bits(last).alias("hi")), lambda e: cover(e["lo"], e["hi"]))
    return F.when(first <= last, ends).otherwise(F.array().cast("array<string>"))


def ranges_of(df: DataFrame, first: str = "first", last: str = "last", network: str | None = None) -> DataFrame:
    """df with `first_key` and `last_key` of each range, from two addresses or from prefix notation; malformed rows drop out."""
    if network is None:
        return df.withColumns({"first_key": ip_key(first), "last_key": ip_key(last)}).dropna(subset=["first_key", "last_key"])
    text = F.trim(as_column(network))
    key, length = ip_key(F.substring_index(text, "/", 1)), F.regexp_extract(text, r"/(\d{1,3})$", 1).try_cast("int")
    length = F.coalesce(length, F.when(~F.contains(text, F.lit("/")), F.when(F.contains(text, F.lit(":")), BITS).otherwise(32)))
    whole = F.when(F.contains(text, F.lit(":")), length).otherwise(length + BITS - 32)

    def ends(s: Column) -> Column:
        low = F.left(bits(s["key"]), s["n"])
        hexed = lambda b: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.lower(F.conv(F.substring(b, i * 4 + 1, F.lit(4)), 2, 16))), "")
        return F.struct(hexed(F.rpad(low, BITS, "0")).alias("first_key"), hexed(F.rpad(low, BITS, "1")).alias("last_key"))

    fine = key.isNotNull() & whole.between(0, BITS) & (length >= 0)
    both = let(F.when(fine, F.struct(key.alias("key"), whole.alias("n"))), lambda s: F.when(s.isNotNull(), ends(s)))
    return df.withColumn("_ends", both).where("_ends IS NOT NULL").select(*df.columns, "_ends.first_key", "_ends.last_key")


def with_ranges(df: DataFrame, ranges: DataFrame, ip: str, payload: tuple[str, ...], around: str | None = None) -> DataFrame:
    """df with the payload columns of the range that holds its address; null for malformed addresses and those in no range.
    `around` names a column for the number of ranges that hold it.

    `ranges` comes from ranges_of. Where ranges overlap, the one that starts last counts, then the one that ends first, so of
    nested ranges the innermost; of equal ranges the least payload. Each range is cut to prefixes, each distinct address is
    looked up by its own prefixes of the lengths in use, in one equality join.
    """
    order = F.struct("first_key", (-F.conv(F.substring("last_key", 1, 12), 16, 10).cast("long")).alias("e1"), (-F.conv(F.substring("last_key", 13, 12), 16, 10).cast("long")).alias("e2"),
                     (-F.conv(F.substring("last_key", 25, 8), 16, 10).cast("long")).alias("e3"))
    one = ranges.groupBy("first_key", "last_key").agg(F.min(F.struct(*payload)).alias("_payload"), F.count("*").alias("_n"))
    cut = one.select(F.explode(range_prefixes(F.col("first_key"), F.col("last_key"))).alias("_prefix"), "_n", F.struct(order.alias("order"), "_payload").alias("_found"))
    cut = cut.groupBy("_prefix").agg(F.max_by("_found", "_found.order").alias("_found"), F.sum("_n").alias("_n"))  # of ranges with one prefix only the best can win there
    lengths = [r[0] for r in cut.select(F.length("_prefix").alias("n")).distinct().collect()]  # 129 values at most
    key = "_address"
    placed = df.withColumn(key, ip_key(ip))
    each = placed.where(F.col(key).isNotNull()).groupBy(key).agg(F.lit(1).alias("_one")).select(key, bits(F.col(key)).alias("_bits"))
    own = F.transform(F.array(*map(F.lit, sorted(lengths))).cast("array<int>"), lambda n: F.left("_bits", n))
    found = each.select(key, F.explode(own).alias("_prefix")).join(cut, "_prefix").groupBy(key).agg(F.max_by("_found", "_found.order").alias("_found"), F.sum("_n").alias("_n"))
    counted = [F.coalesce("_n", F.lit(0)).cast("long").alias(around)] if around else []
    return salted_join(placed, found, key, placed.select(key), tuple(df.columns)).select(*df.columns, *[F.col(f"_found._payload.{p}").alias(p) for p in payload], *counted)


def range_resolver(ranges: DataFrame, lat: str = "lat", lon: str = "lon", ip: str = "ip") -> Callable[[DataFrame], DataFrame]:
    """A resolver for the coordinate waterfall: `ip_lat`, `ip_lon` of the range that holds a public address."""
    def resolve(df: DataFrame) -> DataFrame:
        renamed = ranges.select("first_key", "last_key", F.col(lat).cast("double").alias("ip_lat"), F.col(lon).cast("double").alias("ip_lon"))
        asked = df.withColumn("_public_ip", F.when(is_public_ip(ip), F.col(ip)))
        return with_ranges(asked, renamed, "_public_ip", ("ip_lat", "ip_lon")).drop("_public_ip")

    return resolve
