"""Literal cases of the scoring, wording, normalisation and geography rules."""

import ipaddress


import pytest
from pyspark.sql import functions as F

from habitus.config import FEATURES
from habitus.functions import geo as G, normalize as N, scoring as S
from habitus.functions.maps import set_diff, top_buckets
from habitus.operators.ensemble import check_schema
from habitus.operators.govern import promote, promotion_gate, rollback_model
from habitus.sources.locations import location_registry


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def row(spark, **features):
    values = {f: 0.0 for f in FEATURES} | features
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


@pytest.mark.parametrize("gnn,iso,ae,expected", [
    (.20, .30, .20, .24), (.20, .30, .999, .52), (.03, .99, .999, .99), (.90, .95, .99, .95), (.99, .30, .20, .47)])
def test_escalating_blend(spark, gnn, iso, ae, expected):
    risk, _ = S.blend({"gnn": F.lit(gnn), "isoforest": F.lit(iso), "autoencoder": F.lit(ae)})
    assert one(spark, risk) == pytest.approx(expected, abs=0.006)


def test_blend_with_one_or_no_detector(spark):
    none = F.lit(None).cast("double")
    assert one(spark, S.blend({"gnn": F.lit(0.7), "isoforest": none, "autoencoder": none})[0]) == pytest.approx(0.7)
    assert one(spark, S.blend({"gnn": none, "isoforest": none, "autoencoder": none})[0]) is None


def test_decay_weights(spark):
    got = [one(spark, N.decay_weight(F.lit(float(d)), 90.0)) for d in (0, 30, 90, 180, -5)]
    assert got == pytest.approx([1.0, 0.5 ** (1 / 3), 0.5, 0.25, 1.0])
    assert one(spark, N.decay_weight(F.lit(9.0), 0)) == 1.0


def test_burst_boundaries(spark):
    def signals(**f):
        return row(spark, **f).select(S.triggered_signals().alias("s")).first()["s"]

    assert "velocity_burst" in signals(vel_3m=1.39) and "velocity_burst" in signals(vel_1m=1.10)
    assert "recent_activity" in signals(vel_3m=1.38) and "velocity_burst" not in signals(vel_3m=1.38)
    assert "recent_activity" in signals(vel_1m=1.09)
    assert not {"velocity_burst", "recent_activity"} & set(signals())


def test_safe_text_never_speaks_of_elevated_risk(spark):
    df = row(spark, vel_10m=0.7).withColumns({"risk_score": F.lit(0.0), "is_cold_start": F.lit(False)})
    out = S.decide(df).withColumn("d", S.narrative({"gnn": F.lit(0.1)})).first()
    assert out["status"] == "safe" and out["d"].startswith("Safe.") and "elevated risk" not in out["d"]


def test_default_cuts_and_codes(spark):
    def code(risk, **f):
        return S.decide(row(spark, **f).withColumn("risk_score", F.lit(risk))).first()

    assert code(0.99)["status"] == "unsafe" and code(0.996)["activity_code"] == "BF-400"
    assert code(0.99, vel_1h=2.0)["activity_code"] == "BF-305" and code(0.99, amt_z=-9.0)["activity_code"] == "BF-301"
    assert code(0.91)["activity_code"] == "BF-200" and code(0.6)["activity_code"] == "BF-100" and code(0.1)["activity_code"] == "BF-110"
    assert code(0.99)["zone"] == "priority_1_unsafe"


def test_unsafe_narrative(spark):
    df = row(spark, amt_over_median=12.4, above_max=1.0, beneficiary_new=1.0, hour_rarity=0.95, is_night=1.0, vel_3m=1.39).withColumns(
        {"risk_score": F.lit(0.999), "is_cold_start": F.lit(False)})
    text = S.decide(df).select(S.narrative({"isoforest": F.lit(0.9), "autoencoder": F.lit(0.2), "gnn": F.lit(0.95)}).alias("d")).first()["d"]
    assert text == (
        "Strong multi-signal behavioural anomaly — high risk; immediate review recommended. The transaction amount is approximately 12× the "
        "customer's typical amount and exceeds their historical maximum. In addition, the transaction involves a first-time beneficiary, occurs at "
        "an unusual hour (night-time), and follows a burst of approximately 3 transactions within minutes. Isolation Forest and Graph-structure "
        "model also produced very high anomaly scores.")


def test_explanation_of_a_cold_start(spark):
    df = row(spark, amt_over_median=6.0).withColumns({"risk_score": F.lit(0.99), "is_cold_start": F.lit(True)})
    out = S.explain(S.decide(df), {"isoforest": F.lit(0.86), "gnn": F.lit(0.97)}).first()
    assert out["triggered_signals"] == ["amount_far_above_usual", "detector:gnn", "detector:isoforest", "cold_start"]
    assert out["detection_reason"][0] == "transaction amount is far above the population baseline"
    assert out["detection_reason"][1] == "Graph-structure model anomaly score 0.97"


def test_amount_against_maximum(spark):
    def wording(**f):
        return row(spark, **f).select(S.amount_vs_max().alias("w")).first()["w"]

    assert [wording(above_max=1.0), wording(amt_over_max=1.0), wording(amt_over_max=1 - 1e-7), wording(amt_over_max=0.99)] == ["exceeds", "at", "at", ""]


def test_histogram_tops(spark):
    def top(values, labels=None):
        return one(spark, top_buckets(F.array(*[F.lit(float(v)) for v in values]), labels=labels))

    assert top([0, 0, 5, 3, 0, 0]) == [2, 3] and top([0] * 6) == []
    assert top([.5, 0, 0, 0, 0, .3, 0], ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")) == ["Monday", "Saturday"]


def test_set_difference(spark):
    got = one(spark, set_diff(F.array(F.lit("Lagos"), F.lit("Abuja")), F.array(F.lit("Lagos"), F.lit("Kano"))))
    assert (got["added"], got["removed"], got["kept"]) == (["Kano"], ["Abuja"], ["Lagos"])


def test_normalisation(spark):
    assert [one(spark, N.normalize_currency(F.lit(c))) for c in (None, " ", "naira", " Pound ", "€", "ksh", "xof")] == ["NGN", "NGN", "NGN", "GBP", "EUR", "KES", "XOF"]
    assert one(spark, N.city_of(F.lit("no 9 zafarawa street, Gombi, Adamawa, Nigeria"))) == "Gombi"
    assert one(spark, N.city_of(F.lit("Lagos"))) == "Lagos"
    assert [one(spark, N.ip_subnet_strict(F.lit(x))) for x in ("1.2.3.4", "1.2.3", None)] == ["1.2.3.0/24", None, None]
    assert one(spark, N.coordinate(F.lit("abc"), -90, 90)) is None and one(spark, N.coordinate(F.lit("6.5"), -90, 90)) == 6.5
    assert one(spark, N.mask_ref(F.lit("22430372151"))) == "id:***2151" and one(spark, N.mask_ref(F.lit(None))) == "id:unknown"


def test_segments_and_registry(spark):
    def segments(text):
        return one(spark, F.array_join(G.clean_segments(F.lit(text)), "|"))

    assert [segments("Lafia 950101"), segments("GGVW+VH"), segments("Benin City"), segments("no 9, Gombi, Nigeria")] == ["lafia", "", "benin city", "no|gombi"]
    df = spark.createDataFrame([("Lagos",), ("Surulere, Lagos, Nigeria",), ("Atlantis",), ("n/a",), ("Oyo State",)], "location string")
    got = {r["location"]: (r["loc_name"], r["loc_kind"]) for r in G.registry_lookup(df, location_registry(spark)).collect()}
    assert got["Lagos"] == ("lagos", "city") and got["Surulere, Lagos, Nigeria"] == ("lagos", "city") and got["Atlantis"] == (None, None) and got["n/a"] == (None, None)


def test_public_addresses_agree_with_the_standard_library(spark):
    ips = ["8.8.8.8", "10.1.1.1", "172.16.0.1", "172.32.0.1", "192.168.1.1", "192.0.0.9", "192.0.0.8", "192.0.2.5", "100.64.1.1", "100.128.0.1", "169.254.0.1",
           "198.18.0.1", "198.51.100.9", "203.0.113.7", "224.0.0.1", "239.1.1.1", "240.0.0.1", "255.255.255.255", "0.1.2.3", "127.0.0.1", "1.1.1.1"]
    df = spark.createDataFrame([(i,) for i in ips], "ip string").withColumn("p", G.is_public_ip("ip"))
    for r in df.collect():
        a = ipaddress.ip_address(r["ip"])
        assert r["p"] == (a.is_global and not a.is_multicast), r["ip"]
    assert [one(spark, G.is_public_ip(F.lit(x))) for x in ("1.2.3", "a.b.c.d", "256.1.1.1", "01.2.3.4", None)] == [False] * 5


def test_plus_codes(spark):
    def resolve(text, lat=None, lon=None):
        df = spark.createDataFrame([(text, lat, lon)], "t string, la double, lo double")
        return G.resolve_plus_codes(df, "t", "la", "lo").first()

    zurich = resolve("8FVC9G8F+6X Zurich")
    assert (zurich["pc_lat"], zurich["pc_lon"]) == (pytest.approx(47.3655625), pytest.approx(8.5249375))
    assert resolve("shop 9G8F+6X", 47.4, 8.6)["pc_lat"] == pytest.approx(47.3655625)
    assert resolve("shop 9G8F+6X")["pc_lat"] is None and resolve("no code here")["plus_code"] is None
    assert resolve("8FVC9G8F+6 bad")["plus_code"] is None
    padded = resolve("8FVC0000+ x8FVC9G8F")
    assert padded["plus_code"] in (None, "8FVC0000+")


def test_distance(spark):
    km = one(spark, G.haversine_km(F.lit(6.5244), F.lit(3.3792), F.lit(9.0765), F.lit(7.3986)))
    assert km == pytest.approx(525.5, abs=3)
    assert one(spark, G.geo_velocity_kmh(F.lit(100.0), F.lit(0.0))) == 0.0 and one(spark, G.geo_velocity_kmh(F.lit(100.0), F.lit(2.0))) == 50.0


def test_schema_guard():
    assert check_schema(["a", "b"], ["a", "b"]) == "equal" and check_schema(["a"], ["a", "b"]) == "prefix"
    with pytest.raises(ValueError):
        check_schema(["b"], ["a", "b"])


def test_registry_and_promotion(spark):
    models = spark.createDataFrame([("m1", "active"), ("m0", "previous"), ("m2", "candidate")], "version string, status string")
    after = {r["version"]: r["status"] for r in promote(models, "m2").collect()}
    assert after == {"m2": "active", "m1": "previous", "m0": "retired"}
    back = {r["version"]: r["status"] for r in rollback_model(promote(models, "m2")).collect()}
    assert back == {"m2": "previous", "m1": "active", "m0": "retired"}
    schema = "version string, synthetic_auc double, f1 double"
    new, old = spark.createDataFrame([("n", 0.8, 0.1)], schema), spark.createDataFrame([("o", 0.9, 0.1)], schema)
    assert promotion_gate(new, old).first()["promote"] is False and promotion_gate(old, new).first()["promote"] is True
    assert promotion_gate(new, old.limit(0)).first()["promote"] is True
