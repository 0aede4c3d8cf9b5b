"""Time the headline queries and print one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS].
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidegauge.catalog import QUERIES
from tidegauge.session import local_session

HEADLINE = (
    "src_daily_rollup_supplier",
    "win01_daily_metrics_supplier",
    "agg01_resample_weekly",
    "agg04_operational_summary",
    "agg05_backlog_episodes",
    "agg08_scenario_summary",
    "fn10_kpi_table",
    "agg18_risk_signals",
    "q05_clean_default",
    "q06_audit_findings",
    "win12_rolling_stats",
    "win14_exponential_means",
    "fc13_regression_metrics",
    "fc31_monitor_metrics",
    "fc36_smoke_pipeline",
    "q09_experiment_scores",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, app="bench")
    QUERIES["src_daily_rollup_single"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
