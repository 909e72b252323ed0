"""Time the registered queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 3, the median counts), BENCH_QUERIES (comma separated).
Every query is run once before it is timed, nothing stays cached between runs,
and results go to Spark's noop sink, so that all columns of all rows are made.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from contract.queries import QUERIES  # noqa: E402
from driftscope.session import local_session  # noqa: E402

HEADLINE = (
    "plan_preagg", "group_agg_hash", "compare_hash", "compare_normalized", "regression_overview",
    "regression_summary", "multi_plan_drilldown", "plan_shape_diff", "persisted_regressions", "collection_check",
    "text_dedup_documents", "statement_rewrite", "replay_sequence", "interval_rollup", "stream_interval_rollup",
    "update_by_key", "delete_cascade", "guarded_insert",
)


def run(spark, query, sf_dir: str) -> float:
    spark.catalog.clearCache()
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES")
    spark = local_session(cpus, memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names.split(",") if names else HEADLINE:
        run(spark, QUERIES[name], sf_dir)
        seconds[name] = round(statistics.median(run(spark, QUERIES[name], sf_dir) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
