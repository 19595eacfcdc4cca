"""Print plan features that do not scale, for every registered query: python tools/plans.py [name ...]"""

from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from adloom.plans.catalog import load_all, plain  # noqa: E402
from adloom.plans.frames import Frames  # noqa: E402
from adloom.session import build_session  # noqa: E402

WRITES = {"upserted_table", "range_replaced_table", "accumulated_snapshots", "appended_events", "materialized_sheet",
          "streamed_events", "streamed_tombstones", "streamed_restatement", "streamed_audit", "streamed_calls"}
PATTERNS = {
    "nested-loop": r"BroadcastNestedLoopJoin",
    "cartesian": r"CartesianProduct",
    "single": r"Exchange SinglePartition",
    "python": r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas",
    "window": r"\n[^\n]*\bWindow \[",
    "hash-exch": r"Exchange hashpartitioning",
    "range-exch": r"Exchange rangepartitioning",
    "broadcast": r"BroadcastExchange",
    "scan": r"FileScan parquet",
}


def main() -> None:
    # no broadcast: what remains is the plan for large inputs on every side
    spark = build_session("plans", "local[4]", **{"spark.ui.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"})
    spark.sparkContext.setLogLevel("ERROR")
    catalog = load_all()
    for name in sys.argv[1:] or catalog:
        if name in WRITES:
            continue
        df = plain(catalog[name].build(Frames(spark, "/root/testdata/sf0.01")))
        text = df._jdf.queryExecution().executedPlan().toString()
        if sys.argv[1:]:
            print(text)
        found = {k: len(re.findall(p, text)) for k, p in PATTERNS.items()}
        print(name, {k: v for k, v in found.items() if v}, flush=True)


if __name__ == "__main__":
    main()
