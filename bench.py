"""Time the headline queries: one warm-up, then the median of three runs each."""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from strataforge.plans.catalog import QUERIES  # noqa: E402
from strataforge.session import build_session  # noqa: E402

HEADLINE = (
    "M1_dedup_deterministic",
    "M4_split_conflicts",
    "M5_classify_against_target",
    "M6_merge_newer",
    "M10_silver_batch",
    "A1_kpi_summary",
    "A2_period_mart",
    "J3_star_join",
    "W2_outcome_fact",
    "W3_percent_rank_global",
    "Q12_batched_row_checks",
    "Q21_expectations",
)
RUNS = 5


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    spent = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):
            started = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        spent[name] = round(statistics.median(times[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(spent.values()), 3),
                "unit": "sec",
                "queries": spent,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
