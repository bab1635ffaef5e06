"""Column normalisation: keys, currencies, types, addresses, locations, time parts and decay weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from habitus.config import CURRENCY_ALIASES, FRAUD_WORDS, GENUINE_WORDS


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def entity_key(branch: Column | str, account: Column | str) -> Column:
    """'branch:account'; null when either part is null."""
    return F.concat(as_column(branch).cast("string"), F.lit(":"), as_column(account).cast("string"))


def normalize_currency(c: Column | str, default: str = "NGN") -> Column:
    """Canonical currency code: blank is the default, known spellings are mapped, anything else is trimmed and upper-cased."""
    code = F.nullif(F.upper(F.trim(as_column(c))), F.lit(""))
    aliases = F.create_map(*[F.lit(x) for pair in CURRENCY_ALIASES.items() for x in pair])
    return F.coalesce(aliases[code], code, F.lit(default))


def canonical_type(c: Column | str) -> Column:
    """Transaction type: trimmed and lower-cased, null is blank."""
    return F.lower(F.trim(F.coalesce(as_column(c), F.lit(""))))


def account_type(c: Column | str, mode: str = "peer") -> Column:
    """'peer': null becomes 'unknown'. 'request': corporate, or else individual."""
    if mode == "peer":
        return F.coalesce(as_column(c), F.lit("unknown"))
    return F.when(F.lower(F.trim(as_column(c))) == "corporate", "corporate").otherwise("individual")


def boolish(c: Column | str) -> Column:
    """Text or boolean to boolean: t, true and 1 are true; null stays null."""
    return F.lower(as_column(c).cast("string")).isin("t", "true", "1")


def city_of(location: Column | str) -> Column:
    """City from free text: the second comma token, or the only one."""
    parts = F.split(as_column(location), ",")
    return F.trim(F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0))))


def ip_subnet_loose(c: Column | str) -> Column:
    """Replace the last octet; text without one is left as it is."""
    return F.regexp_replace(as_column(c), r"\.\d+$", ".0/24")


def ip_subnet_strict(c: Column | str) -> Column:
    """The /24 of a four-part address; anything else is null."""
    parts = F.split(as_column(c), r"\.")
    return F.when(F.size(parts) == 4, F.concat(F.array_join(F.slice(parts, 1, 3), "."), F.lit(".0/24")))


def canonical_location(c: Column | str) -> Column:
    """Trimmed and lower-cased; blank is null."""
    return F.nullif(F.lower(F.trim(as_column(c))), F.lit(""))


def coordinate(c: Column | str, low: float, high: float) -> Column:
    """Optional coordinate: text that is no number, and numbers out of range, become null."""
    v = as_column(c).try_cast("double")
    return F.when(v.between(low, high) & ~F.isnan(v), v)


def mask_ref(c: Column | str) -> Column:
    """Customer reference for logs: only the last four characters stay readable."""
    c = as_column(c).cast("string")
    return F.when(F.coalesce(c, F.lit("")) == "", "id:unknown").otherwise(F.concat(F.lit("id:***"), F.right(c, F.lit(4))))


def canonical_verdict(c: Column | str) -> Column:
    """Analyst verdict: genuine or fraud; null when the word is unknown."""
    word = F.lower(F.trim(as_column(c)))
    return F.when(word.isin(*GENUINE_WORDS), "genuine").when(word.isin(*FRAUD_WORDS), "fraud")


def stable_key(identifier: Column | str, account: Column | str, txn: Column | str) -> Column:
    """Customer identifier, or else account number, or else the transaction id."""
    blank = F.lit("")
    return F.coalesce(*[F.nullif(as_column(c).cast("string"), blank) for c in (identifier, account, txn)])


def days_between(later: Column | str, earlier: Column | str) -> Column:
    """Exact difference in days, fractions included."""
    return (F.unix_micros(as_column(later)) - F.unix_micros(as_column(earlier))) / F.lit(86_400_000_000.0)


def decay_weight(age_days: Column | str, half_life: float) -> Column:
    """0.5 ** (age / half_life); negative and unknown ages count as zero, a non-positive half life turns decay off."""
    if half_life <= 0:
        return F.lit(1.0)
    age = F.greatest(F.coalesce(as_column(age_days), F.lit(0.0)), F.lit(0.0))
    return F.pow(F.lit(0.5), age / F.lit(float(half_life)))


def iso_weekday(ts: Column | str) -> Column:
    """Monday is 1, Sunday is 7."""
    return F.weekday(as_column(ts)) + 1


def is_night(ts: Column | str) -> Column:
    """Before six in the morning."""
    return F.hour(as_column(ts)) < 6


WINDOW_DAYS = {"in_24h": 1, "in_7d": 7, "in_30d": 30, "in_60d": 60, "in_90d": 90}


def with_time_parts(df: DataFrame, as_of: Column, ts: str = "ts") -> DataFrame:
    """Add hour, both weekday numberings, night flag, age in days and the recency flags."""
    df = df.withColumns({
        "hour": F.hour(ts), "iso_dow": iso_weekday(ts), "dow": F.weekday(F.col(ts)),
        "is_night": is_night(ts), "age_days": days_between(as_of, ts),
    })
    return df.withColumns({n: F.col("age_days") <= d for n, d in WINDOW_DAYS.items()})


def exact(c: Column | str) -> Column:
    """Amounts as fixed-point numbers, so that sums do not depend on the order of addition."""
    return as_column(c).cast("decimal(18,2)")


def exact_sum(c: Column | str) -> Column:
    return F.coalesce(F.sum(exact(c)), F.lit(0)).cast("double")
