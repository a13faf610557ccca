"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up and three times for measure (median). The whole result is computed and
counted (a no-op write), not just a few rows.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from newsreach.plans.registry import load  # noqa: E402
from newsreach.session import build_session  # noqa: E402

HEADLINE = {
    "flagship": "flagship_stratified_midrank",
    "rollup": "A1_clip_rollup",
    "stratified_top": "W3_stratified_top",
    "month_midrank": "W4_month_midrank",
    "regional_lift": "A5_lift",
    "regional_reach": "A6_regional_reach",
    "search": "V3_search",
    "search_pivots": "V3_search_pivots",
    "plan_score": "V4_plan_score",
    "distinctive_outlets": "V5_distinctive_overall",
    "paired_effect": "A21_paired_effect",
    "ndcg": "M5_grouped_ndcg",
    "spearman": "M3_spearman",
    "html_to_text": "C1_html_to_text",
    "upsert": "U1_upsert_events",
    "temporal_split": "M9_temporal_split",
    "bootstrap_gap": "M7_bootstrap_gap",
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    built, _ = load()
    seconds: dict[str, float] = {}
    for label, name in HEADLINE.items():
        times = []
        for attempt in range(runs + 1):
            start = time.perf_counter()
            built[name](spark, folder).write.format("noop").mode("overwrite").save()
            if attempt:
                times.append(time.perf_counter() - start)
        seconds[label] = round(statistics.median(times), 3)
        print(f"{label}: {seconds[label]}", file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "sum of median warm seconds over headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
