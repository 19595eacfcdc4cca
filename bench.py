"""Wall time of the headline queries: one warm-up, median of the timed runs, results fully computed."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from adloom.plans.catalog import load_all, runner  # noqa: E402
from adloom.session import build_session  # noqa: E402

HEADLINE = [
    "calls_attribution", "calls_daily", "ads_daily_table", "dow_hour_grid", "cost_per_lead", "cpl_latest_vs_previous",
    "alerts_active", "alert_by_manager", "client_heatmap_90d", "spend_daily_unified", "actual_spend_all", "budget_base_current",
    "budget_matrix", "pacing_api", "pacing_context", "budget_rollover", "target_with_catchup", "rule_registry", "user_access",
    "campaign_triage", "waste_by_cause", "rule_verdicts", "overlapping_windows", "negative_conflicts", "upserted_rows", "upserted_table", "range_replaced_table",
    "streamed_restatement",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    catalog = load_all()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        run = runner(catalog[name])
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
    spark.stop()
    sf = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
