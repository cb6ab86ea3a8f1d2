"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from ledgerline.queries import QUERIES
from ledgerline.session import build_session

HEADLINE = [
    "entity_profile", "linked_profile", "entity_table", "asof_history", "asof_last_record", "nearest_within", "lookup_join", "membership_flags",
    "coverage_report", "latest_per_key", "filtered_latest", "pair_counterpart", "dedup_subset", "duplicate_counts",
    "delivery_compare", "table_profile", "weekly_counts", "histogram", "label_conflicts", "conflict_rows", "method_labels",
    "date_repair", "ages", "score_curves", "stratified_folds", "chunks_recursive", "chunks_window", "html_page_text",
    "topk_similar_vectors", "history_window", "retrieval_prompts", "logistic_odds",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    chosen = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in chosen:
        run(spark, name, sf_dir)  # warm-up
        times[name] = round(sorted(run(spark, name, sf_dir) for _ in range(repeats))[repeats // 2], 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(scale.group(1)) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
