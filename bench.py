"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``: one warm-up, median of three, one JSON line.

``BENCH_KEYS`` (comma separated, or ``all``) chooses other queries; ``BENCH_RUNS`` the number of timed runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from millrace.queries import collect  # noqa: E402
from millrace.runtime import session  # noqa: E402

HEADLINE = [
    "profile_basic", "profile_numeric", "profile_percentiles", "top_values", "profile_table", "key_inference", "schema_drift",
    "group_sum_count", "lookup_record", "lookup_salted", "fk_assign", "ip_range_enrich", "dedup_keep_first", "detect_duplicates",
    "top_k_per_group", "rolling_window_avg", "inactivity_gaps", "enforce_order", "cdc_apply", "upsert_merge", "route_on_attribute",
    "validate_record_split", "expectations", "quarantine", "silver_conform", "generate_table", "gen_integer", "ks_distance",
    "fidelity_table", "split_text", "html_extract", "content_findings", "phi_values", "fuzzy_groups", "near_duplicates", "reachability",
    "topo_levels", "stream_tumbling", "stream_session", "stream_medallion",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    found, _ = collect()
    asked = os.environ.get("BENCH_KEYS", "")
    keys = list(found) if asked == "all" else [k for k in asked.split(",") if k] or HEADLINE
    spark = session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for key in keys:
        took = []
        for run in range(runs + 1):
            start = time.perf_counter()
            found[key](spark, folder).write.format("noop").mode("overwrite").save()
            if run or runs == 0:
                took.append(time.perf_counter() - start)
        times[key] = round(statistics.median(took), 3)
        print(f"{key} {times[key]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder}))


if __name__ == "__main__":
    main()
