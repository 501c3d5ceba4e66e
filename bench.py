"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docwarden.operators import detect
from docwarden.plans.enriched import enriched_documents
from docwarden.plans.queries import QUERIES

HEADLINE = (
    "scan_summary", "findings_by_category", "redacted_docs", "risk_by_batch", "risk_reasons",
    "observations", "final_report", "qa_router", "framework_map", "heatmap", "action_plan",
    "keyword_signals", "ruler_signals", "chunks", "terms", "hash_vectors", "retrieve_top4",
    "lexical_top4", "vector_topk", "context_pack", "history_facts", "map_to_source",
    "combined_text", "analysis_fingerprints", "merge_summaries", "merge_answers",
    "user_documents_all", "admin_users", "admin_documents", "admin_audits", "history_search",
    "trace_monitoring", "feedback_by_category", "stream_scan", "stream_monitor",
)


def run(df) -> float:
    """Execute the whole plan, keeping every column, without collecting rows."""
    started = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    docs = enriched_documents(spark, folder)
    size = docs.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    run(detect.scan(detect.spread(docs)))  # warm-up: class loading and JIT
    seconds = {}
    for name in HEADLINE:
        started = time.time()
        run(QUERIES[name](spark, folder))
        seconds[name] = round(time.time() - started, 3)
    scan_seconds = run(detect.scan(detect.spread(enriched_documents(spark, folder))))
    print(json.dumps({
        "metric": "total seconds for the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": folder.rstrip("/").split("sf")[-1],
        "scan": {
            "seconds": round(scan_seconds, 3),
            "documents_per_sec": round(size["n"] / scan_seconds, 1),
            "chars_per_sec": round(size["chars"] / scan_seconds),
        },
    }))
    spark.stop()


if __name__ == "__main__":
    main()
