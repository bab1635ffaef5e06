"""Location registry: names of states and cities with approximate centroids (WGS84)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Public centroid coordinates, 36 states and 45 cities, (latitude, longitude).
STATES = {
    "abia": (5.532, 7.486),
    "adamawa": (9.2035, 12.4954),
    "akwa ibom": (5.0377, 7.9128),
    "anambra": (6.2109, 7.0741),
    "bauchi": (10.3103, 9.8439),
    "bayelsa": (4.921, 6.2642),
    "benue": (7.7337, 8.5217),
    "borno": (11.8333, 13.15),
    "cross river": (4.9589, 8.3269),
    "delta": (6.198, 6.7285),
    "ebonyi": (6.3249, 8.1137),
    "edo": (6.335, 5.6037),
    "ekiti": (7.621, 5.2214),
    "enugu": (6.4584, 7.5464),
    "gombe": (10.2897, 11.1673),
    "imo": (5.4836, 7.0332),
    "jigawa": (11.7563, 9.339),
    "kaduna": (10.5222, 7.4383),
    "kano": (12.0022, 8.592),
    "katsina": (12.9908, 7.6018),
    "kebbi": (12.4539, 4.1975),
    "kogi": (7.8023, 6.7333),
    "kwara": (8.4966, 4.5426),
    "lagos": (6.5244, 3.3792),
    "nasarawa": (8.4939, 8.5155),
    "niger": (9.6139, 6.5569),
    "ogun": (7.1557, 3.3451),
    "ondo": (7.2508, 5.2103),
    "osun": (7.7669, 4.5566),
    "oyo": (7.3775, 3.947),
    "plateau": (9.8965, 8.8583),
    "rivers": (4.8156, 7.0498),
    "sokoto": (13.0059, 5.2476),
    "taraba": (8.8833, 11.3667),
    "yobe": (11.748, 11.966),
    "zamfara": (12.1628, 6.6614),
}
CITIES = {
    "abuja": (9.0765, 7.3986),
    "fct": (9.0765, 7.3986),
    "federal capital territory": (9.0765, 7.3986),
    "lagos": (6.5244, 3.3792),
    "ikeja": (6.6018, 3.3515),
    "lekki": (6.4698, 3.5852),
    "ibadan": (7.3775, 3.947),
    "kano": (12.0022, 8.592),
    "port harcourt": (4.8156, 7.0498),
    "benin city": (6.335, 5.6037),
    "kaduna": (10.5222, 7.4383),
    "enugu": (6.4584, 7.5464),
    "jos": (9.8965, 8.8583),
    "lafia": (8.4939, 8.5155),
    "makurdi": (7.7337, 8.5217),
    "warri": (5.5167, 5.75),
    "asaba": (6.198, 6.7285),
    "abeokuta": (7.1557, 3.3451),
    "akure": (7.2508, 5.2103),
    "ilorin": (8.4966, 4.5426),
    "maiduguri": (11.8333, 13.15),
    "calabar": (4.9589, 8.3269),
    "uyo": (5.0377, 7.9128),
    "owerri": (5.4836, 7.0332),
    "onitsha": (6.1667, 6.7833),
    "aba": (5.1167, 7.3667),
    "zaria": (11.0855, 7.7199),
    "sokoto": (13.0059, 5.2476),
    "osogbo": (7.7669, 4.5566),
    "minna": (9.6139, 6.5569),
    "bauchi": (10.3103, 9.8439),
    "gombe": (10.2897, 11.1673),
    "yola": (9.2035, 12.4954),
    "umuahia": (5.532, 7.486),
    "awka": (6.2109, 7.0741),
    "yenagoa": (4.921, 6.2642),
    "abakaliki": (6.3249, 8.1137),
    "ado ekiti": (7.621, 5.2214),
    "dutse": (11.7563, 9.339),
    "katsina": (12.9908, 7.6018),
    "birnin kebbi": (12.4539, 4.1975),
    "lokoja": (7.8023, 6.7333),
    "damaturu": (11.748, 11.966),
    "gusau": (12.1628, 6.6614),
    "jalingo": (8.8833, 11.3667),
}

# Text that stands for "no location", and tokens that only name the country.
PLACEHOLDERS = ("", "-", ".", "..", "...", "n/a", "n\\a", "na", "null", "none", "nil", "unknown", "nan")
COUNTRY_TOKENS = ("nigeria", "ng", "nga")

SCHEMA = "name string, kind string, lat double, lon double"


def location_registry(spark: SparkSession) -> DataFrame:
    """The registry as a dimension table (name, kind, lat, lon); 81 rows by construction."""
    rows = [(n, "state", *p) for n, p in STATES.items()] + [(n, "city", *p) for n, p in CITIES.items()]
    return spark.createDataFrame(rows, SCHEMA)
