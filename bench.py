"""Time the headline queries; prints one JSON line.

Each query is run once to warm up code generation and once timed, with the
result written to a no-op sink so that every row is produced and none is
collected. Of queries that take over 30 seconds the first run is kept. Resampling
queries run at their defaults, the published budgets.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship_delta_mae_by_item_source", "join4_pairing_audit", "join5_assemble_wide", "prj28_coercing_parser",
    "prj34_repair_from_raw", "agg14_icc_one_way", "agg15_mean_rank_by_message", "agg24_grouping_grid", "agg28_run_health",
    "met2_wasserstein", "met5_leave_one_out_median", "sta1_sign_flip_grid", "sta4_cluster_sign_flip", "sta5_omnibus",
    "sta7_cluster_bootstrap", "sta9_rank_summary", "sta13_correlation_grid", "sta14_chi_square_vs_baseline",
    "sta18_brown_forsythe_change", "sta26_source_sweep", "sta29_effect_report_full", "reg8_random_intercept_reml",
    "pii3_pseudonymise_text", "pii5_pattern_triage", "str1_stream_latest_wins",
]


def main() -> None:
    from paneloom.plans import catalog
    from paneloom.session import drop_work, local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")
    times = {}
    for name in names:
        for _ in range(2):
            start = time.time()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
            if times[name] > 30:  # long enough for its warm-up not to count
                break
    drop_work(spark)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "replicates": "published budgets", "sf": os.path.basename(sf_dir).removeprefix("sf")}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
