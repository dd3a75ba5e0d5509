"""Benchmark: wall time of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is run once to warm up, then timed ``BENCH_REPEATS`` times (median),
forcing full evaluation with a no-op write.  Prints one JSON line.
"""
from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskframe.plans.registry import load_all, run  # noqa: E402
from riskframe.session import get_spark, release  # noqa: E402

# One or two headline queries per operator family (flagship first).
HEADLINE = [
    "prt3_portfolio", "agg7_snapshot", "fea9_features", "sco6_company_risk", "sco8_top_drivers",
    "sco9_global_importance", "prc5_roi_grid", "prt8_hrs_histogram", "ing3_normalize_wearable",
    "ing17_upsert_roster", "hrm16_pivot_labs", "hrm9_harmonize", "agg12_lab_training_rows",
    "map9_parse_notes", "map11_align_distribution", "dq2_describe_numeric", "fai2_fairness_report",
    "par3_score_parity",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = os.environ.get("BENCH_QUERIES")
    spark = get_spark(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": str(max(8, int(cpus) * 2))})
    reg = load_all()
    names = names.split(",") if names else [n for n in HEADLINE if n in reg]
    times = {}
    for n in names:
        try:
            run(n, spark, sf_dir).write.format("noop").mode("overwrite").save()
            ts = []
            for _ in range(repeats):
                t0 = time.perf_counter()
                run(n, spark, sf_dir).write.format("noop").mode("overwrite").save()
                ts.append(time.perf_counter() - t0)
                release(spark)  # intermediate tables of the run
            times[n] = round(statistics.median(ts), 4)
            print(f"bench: {n} {times[n]}s", file=sys.stderr, flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"bench: {n} failed: {type(e).__name__}: {str(e)[:200]}", file=sys.stderr)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_wall_time", "value": round(sum(times.values()), 4),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
