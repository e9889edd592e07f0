"""Headline timings: one JSON line with seconds per query.

Runs on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``. Every query is evaluated in
full into a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

from recordmill.session import build_session
from recordmill.testbed.registry import QUERIES, results_path

HEADLINE = [
    "extraction_run", "extraction_outcome", "schema_gate_invoice", "parse_json_strict", "validate_all", "confidence_all",
    "word_count", "chunks", "embed_hashed", "search_topk", "search_topk_vectors", "retrieve_fanout", "relevant_context",
    "context_reduction", "vector_upsert", "cosine_score", "infer_replay", "prompts", "cost_for_provider",
    "batch_summary", "report_summary", "recommendations", "review_queue", "report_lines", "batch_csv", "stream_ingest",
    "search_topk_filtered", "src_text_folder", "src_results_json", "sink_json", "latest_run",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": cpus, "spark.recordmill.inputTasks": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    # workers and the parquet reader start outside the clock
    spark.range(8).selectExpr("id").mapInArrow(lambda batches: batches, "id bigint").count()
    seconds: dict[str, float] = {}

    def timed(name: str, action) -> None:
        start = time.perf_counter()
        action()
        seconds[name] = round(time.perf_counter() - start, 3)

    if not sys.argv[1:]:
        # two runs written to the results table the reports read
        timed("results_table", lambda: results_path(spark, sf_dir))
    for name in names:
        timed(name, lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
