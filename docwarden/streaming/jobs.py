"""The batch plan on streams.

Detection is stateless, so the same column expressions run on a stream. State
exists only for the once-only append and the windowed monitors, and all of it is
bounded by the watermark.
"""

from __future__ import annotations

import json

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from docwarden.functions.masking import redacted
from docwarden.operators.detect import scan, spread
from docwarden.operators.monitoring import is_fallback
from docwarden.operators.risk import assess
from docwarden.sources.files import load_text_files, rejected_files, with_file_type
from docwarden.streaming.keyed import append_new


def read_stream(
    spark: SparkSession, path: str, schema: StructType | str, max_files: int = 1_000
) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def stream_scan(docs: DataFrame) -> DataFrame:
    """Scan, assess and redact a document stream (append mode)."""
    return redacted(assess(scan(docs))).drop("text")


def stream_persist(
    analyses: DataFrame, target: str, checkpoint: str, delay: str = "1 hour", available_now=False
):
    """Append each analysis once.

    Duplicates inside the watermark are dropped by state; replayed micro-batches
    and later repeats are caught by the key index of the target table, which
    ``keyed.read_keyed`` reads.
    """
    once = analyses.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(
        ["analysis_id"]
    )
    writer = once.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: append_new(batch, target, batch_id, checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def monitor(traces: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Calls, latency and fallback share per tumbling window (batch or stream)."""
    source = traces.withWatermark("created_at", delay) if traces.isStreaming else traces
    return source.groupBy(F.window("created_at", window).alias("w")).agg(
        F.count("*").alias("calls"),
        F.count_if(is_fallback()).alias("fallbacks"),
        F.max("latency_ms").alias("max_latency_ms"),
    ).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        "calls", "fallbacks", "max_latency_ms",
        F.round(F.col("fallbacks") / F.col("calls"), 6).alias("fallback_rate"),
    )


def scan_monitor(
    scans: DataFrame, window: str = "1 hour", delay: str = "10 minutes", key: str = "doc_id"
) -> DataFrame:
    """Documents, findings, high-risk documents and fallback share per tumbling window.

    ``scans``: assessed documents with ``created_at`` and, for the fallback share, the ``status``
    and ``model_provider`` of their model call. On a stream a document counts once within the
    watermark, and one that is older than the watermark is late: it is dropped on its own, before
    windows are formed, so that ``late_rows`` counts documents. Both states end with the watermark,
    and only narrow columns reach them.
    """
    called = {"status", "model_provider"} <= set(scans.columns)
    narrow = scans.select(
        key, "created_at", F.col("n_findings").cast("long").alias("n_findings"),
        (F.col("risk_level") == "High Risk").alias("high"),
        (is_fallback() if called else F.lit(None).cast("boolean")).alias("fallback"),
    )
    if scans.isStreaming:
        narrow = narrow.withWatermark("created_at", delay).dropDuplicatesWithinWatermark([key])
    rate = F.round(F.col("fallbacks") / F.col("documents"), 6)
    counted = narrow.groupBy(F.window("created_at", window).alias("w")).agg(
        F.count("*").alias("documents"), F.sum("n_findings").alias("findings"),
        F.count_if("high").alias("high_risk"), F.count_if("fallback").alias("fallbacks"),
    )
    shares = [F.col("fallbacks"), rate.alias("fallback_rate")] if called else []
    return counted.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        "documents", "findings", "high_risk", *shares,
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows that the query's latest progress reports say came after the watermark.

    Spark keeps the last ``spark.sql.streaming.numRecentProgressUpdates`` reports; a service that
    runs on collects the same numbers with a listener."""
    return sum(
        operator["numRowsDroppedByWatermark"]
        for progress in query.recentProgress for operator in json.loads(progress.json)["stateOperators"]
    )


def write_batches(stream: DataFrame, checkpoint: str, available_now: bool = False, **sinks):
    """Write what each sink makes of a micro-batch to a folder of its own below the sink's.

    ``sinks`` are ``name=(target, plan)``. A batch is read once for all sinks, dealt out anew only
    if it has fewer splits than the cluster has cores, and its folders are overwritten by a retry.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        dealt = spread(batch)
        several = len(sinks) > 1
        if several:
            dealt = dealt.persist(StorageLevel.DISK_ONLY)
        try:
            for target, plan in sinks.values():
                plan(dealt).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
        finally:
            if several:
                dealt.unpersist()

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


#: Columns of the binary file source.
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(spark: SparkSession, path: str, max_bytes: str | None = "1g", max_files: int | None = None) -> DataFrame:
    """New files below ``path``, whole, in micro-batches of bounded size."""
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    elif max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return with_file_type(reader.load(path).select("path", "content"))


def stream_documents(files: DataFrame, documents: str, rejects: str, checkpoint: str, available_now: bool = False):
    """Load text and table files of a stream as documents; the rest goes to ``rejects`` with a reason."""
    return write_batches(
        files, checkpoint, available_now,
        documents=(documents, load_text_files), rejects=(rejects, rejected_files))
