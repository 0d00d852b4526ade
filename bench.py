"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from hostweave.config import FuseConfig
from hostweave.operators.merge import fused_campaigns
from hostweave.plans import catalog
from hostweave.plans.telemetry import load_telemetry
from hostweave.session import build_session

NAMES = (
    "d01_fanout_suppliers", "d02_shared_key_parts", "d05_all_signals", "d06_detector_campaigns", "d09_baseline_joins", "f05_gap_sessions",
    "f05_order_sessions", "f10_numbered_clusters", "n21_event_numbers", "n16_macos_net", "a02_signed", "a03_a04_a05_verified", "a07_replays",
    "r05_status", "e03_e05_e07_pack_scores", "e13_break_points", "t05_stream_sessions",
)


def fused_300_hosts(spark, sf_dir):
    """Cross-host campaigns of a fleet of 300 hosts, with hourly sessions."""
    cfg = FuseConfig(window_seconds=3600, resume_window_seconds=7200, recon_min_distinct=101)
    return fused_campaigns(load_telemetry(spark, sf_dir, 300), cfg, with_evidence=False)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    runs = {n: catalog.QUERIES[n] for n in NAMES}
    runs["fused_campaigns_300_hosts"] = fused_300_hosts
    only = sys.argv[1:]
    for warm in ("d05_all_signals", "f05_gap_sessions"):
        runs[warm](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name, fn in runs.items():
        if only and name not in only:
            continue
        start = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
