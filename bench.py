"""Headline queries, timed: prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Every query runs to its last row (noop sink); the time is the best of the runs
after one warm-up, so that it measures the plan and not the class loader.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pairloom.plans import all_checks  # noqa: E402
from pairloom.session import build_session  # noqa: E402

HEADLINE = (
    # curation jobs
    "template_summary", "enrich_row", "sql_template", "error_class", "classify_json", "generation_stats",
    "concat_batches", "failure_cutoff", "seeded_shuffle", "per_db_limit", "batch_to_json", "build_prompt",
    "execution_by_source", "zip_ratings", "semantic_by_target", "chain_labels", "sink_labelled", "run_workload",
    # relational shapes
    "k_multi_join", "k_join_derived", "k_join_extra_pred", "k_anti_not_in", "k_count_distinct", "k_sum_avg",
    "k_top_group", "k_intersect", "k_group_year_top", "k_count_subquery",
)
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    checks = all_checks()
    wanted = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in wanted:
        spent = []
        for _ in range(1 + RUNS):
            start = time.perf_counter()
            checks[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - start)
        times[name] = round(min(spent[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
