"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then three times; the least time counts. The session start is reported apart.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "segment_lines segment_overview split_long_parts search_segments dedup_fanout tm_lookup tm_backfill batch_packing context_windows status_stats doc_state precheck "
    "word_candidates term_consistency term_impact search_replace_preview export_txt export_md_table run_rollup html_blocks"
).split()
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    from pyspark.sql import SparkSession

    from textloom import plans

    began = time.perf_counter()
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1).count()
    start = time.perf_counter() - began
    took = {}
    queries = plans.queries()
    for name in HEADLINE:
        best = None
        for k in range(RUNS + 1):
            t = time.perf_counter()
            queries[name](spark, SF).write.format("noop").mode("overwrite").save()
            t = time.perf_counter() - t
            if k:
                best = t if best is None else min(best, t)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "sum of best times of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF, "session_start_sec": round(start, 2)}))
    spark.stop()


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    main()
