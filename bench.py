"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS (default 4) the local cores. One run
starts the session up; then every query is timed once over its whole result (the noop sink forces every row and column).
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "f06_dedup", "s05_upsert", "a01_profile_core", "a03_conditional_sums", "a04_distinct_beneficiaries", "a08_decayed_amounts", "a11_entropy",
    "a12_hour_histogram", "a16_peer_baseline", "j02_assembled_profile", "w04_top_values", "w01_velocity_sales", "w08_weighted_quantiles",
    "a17_model_baseline", "a19_graph_features", "x03_novelty", "x06_feature_matrix", "x07_blend", "x12_detection_reasons", "x13_narrative",
    "w11_roc_auc", "m07_score_quantiles", "m08_tier_cuts", "x21_coordinate_waterfall", "o02_live_precision", "r02_live_velocity", "f11_history_window",
    "x21_address_ranges", "m12_score_requests", "r10_status_corrections",
)


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from habitus.plans.catalogue import QUERIES
    from habitus.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, shuffle=int(cpus) if cpus.isdigit() else 8, memory=os.environ.get("BENCH_MEMORY", "6g"))
    QUERIES[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up is not part of any query
    times: dict[str, float] = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "rows": rows, "cpus": cpus}))


if __name__ == "__main__":
    main()
