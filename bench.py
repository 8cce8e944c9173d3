"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

A query's time is the median of $BENCH_RUNS runs; ``first_run`` shows the first one, which also builds derived inputs. A query that fails is
listed and makes the exit code 1.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "swap_normalization", "rolling_last_events", "rolling_last_events_hot_pools", "pool_states", "pool_drawdown", "horizon_outcomes", "decision_outcomes",
    "opportunity_features", "market_features", "market_features_hot_pools", "context_features", "account_history", "latency_percentiles",
    "classify_duplicates", "latest_state_as_of", "dataset_fingerprint", "publish_unique", "replay_parity",
    "slot_states", "chain_conflicts", "coverage_report", "compare_captures", "timeline_as_of",
    "native_transfers", "decode_coverage", "protocol_events",
    "entry_rules", "risk_vetoes", "evidence_join", "ledger_states", "cycle_reports", "quota_breaches", "alert_transitions", "stream_pool_features",
]
EVENT_QUERIES = ("opportunity_features", "market_features", "context_features", "stream_pool_features")


def main() -> None:
    from tidemark.plans import QUERIES
    from tidemark.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, app="tidemark-bench")
    names = sys.argv[1:] or HEADLINE
    events = spark.read.parquet(f"{sf}/events.parquet").count()
    QUERIES["swap_normalization"](spark, sf).write.format("noop").mode("overwrite").save()  # warm the JVM
    times, rates, first, failed = {}, {}, {}, []
    for name in names:
        took = []
        try:
            for _ in range(runs):
                t0 = time.perf_counter()
                QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
                took.append(time.perf_counter() - t0)
        except Exception as exc:  # noqa: BLE001 - one broken query must not hide the others
            print(f"{name}: {str(exc)[:300]}", file=sys.stderr)
            failed.append(name)
            continue
        print(f"{name} {took}", file=sys.stderr)
        times[name], first[name] = round(statistics.median(took), 3), round(took[0], 3)
        if name in EVENT_QUERIES:
            rates[name] = round(events / times[name])
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": sf.rsplit("sf", 1)[-1], "cores": cpus, "events": events, "events_per_sec": rates, "runs": runs, "first_run": first, "failed": failed}))
    if failed:
        sys.exit(1)


if __name__ == "__main__":
    main()
