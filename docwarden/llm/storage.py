"""Intermediate tables in the shared folder, and Arrow batches of bounded size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of one Arrow batch handed to a Python worker.
BATCH_BYTES = 2 << 20


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder name below ``spark.checkpoint.dir``; whoever sets that folder clears it.

    Only a local-mode session that names no such folder, as in tests, gets one of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = tempfile.gettempdir()
    return f"{shared.rstrip('/')}/llm-{uuid.uuid4()}"


def stored(df: DataFrame) -> DataFrame:
    """Write a narrow table that several steps use to the shared folder and read it back.

    Lineage ends there: a lost executor makes nothing before it run again. So the shuffle files
    of the job that wrote the table are dropped with it, and disk use is that of one step.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def bounded_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes where the session does not do so, for very long texts."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, str(2**63 - 1)):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
