"""Seconds per headline query; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [--all | name ...]

Each query runs to completion into a sink that discards rows: once to warm up, then up to three
times, of which the median counts (a slow query stops repeating after ``ENOUGH`` seconds).
``calibration`` is a fixed query over generated numbers that no change of ours touches; it
tells a slow host from a slow query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from quarrywork.plans import load_all
from quarrywork.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS, ENOUGH = 3, 4.0

HEADLINE = (
    "usage_summary", "by_type", "agent_stats", "sandbox_stats", "quality_stats", "cost_by_model",
    "md_to_plain", "md_to_text", "redact_emails", "md_sections", "text_stats", "md_structure", "readability",
    "detect_language", "keywords_freq", "keywords_tfidf",
    "chunk_fixed", "chunk_token", "chunk_char", "chunk_sentence", "chunk_headers",
    "embed_hash", "retrieve_topk", "retrieve_multi", "retrieve_vectors", "dedup_text",
    "route_prompt", "eval_fallback", "retry_select", "fallback_choice", "ab_results", "guard_sql",
    "perf_report", "metric_histogram", "concurrency_profile", "moving_avg_100", "session_gaps", "combine_context",
    "join_inner", "join_asof", "agg_basic", "win_rank", "win_frame", "set_except", "sandbox_query",
    "scan_csv", "load_sql_dump", "html_to_text",
    "rate_limit_batch", "circuit_breaker_batch", "stream_counts", "stream_sessions", "stream_rate_limit",
)


def main() -> None:
    registry = load_all()
    names = list(registry) if "--all" in sys.argv else [a for a in sys.argv[1:] if a in registry] or list(HEADLINE)
    spark = build_session(
        "bench", f"local[{CPUS}]", spark__ui__enabled="false", spark__sql__shuffle__partitions=CPUS,
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(df) -> float:
        start = time.perf_counter()
        df().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    def median(df) -> float:
        timed(df)
        runs: list[float] = []
        while len(runs) < RUNS and sum(runs) < ENOUGH:
            runs.append(timed(df))
        return round(statistics.median(runs), 3)

    calibration = median(lambda: spark.range(20_000_000).selectExpr("sum(hash(id)) AS s"))
    seconds = {name: median(lambda: registry[name].build(spark, SF_DIR)) for name in names}
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "calibration": calibration, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
