"""Document files: type dispatch, decoding and text loading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarden.functions.text import strip
from docwarden.sources.csv_text import flatten_csv, infer_delimiter

# --- fixed values: Windows-1252 -------------------------------------------
CP1252_UNDEFINED = (0x81, 0x8D, 0x8F, 0x90, 0x9D)
_C1 = [b for b in range(0x80, 0xA0) if b not in CP1252_UNDEFINED]
_C1_CHARS = "".join(chr(b) for b in _C1)
_CP1252_CHARS = bytes(_C1).decode("cp1252")
BOM = "﻿"
SUPPORTED = ("pdf", "txt", "csv")


def decode_text(content: Column) -> Column:
    """UTF-8 (mark dropped), else Windows-1252, else Latin-1."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    without_mark = F.when(F.startswith(utf8, F.lit(BOM)), F.substring(utf8, 2, 2**31 - 1)).otherwise(
        utf8
    )
    latin1 = F.decode(content, "ISO-8859-1")
    undefined = latin1.rlike("[" + "".join(f"\\x{b:02x}" for b in CP1252_UNDEFINED) + "]")
    single_byte = F.when(undefined, latin1).otherwise(
        F.translate(latin1, _C1_CHARS, _CP1252_CHARS)
    )
    return F.coalesce(without_mark, single_byte)


def with_file_type(files: DataFrame) -> DataFrame:
    """Add file_name and suffix (after the last dot, lower case)."""
    name = F.regexp_extract("path", r"([^/]+)\z", 1)
    return files.withColumn("file_name", name).withColumn(
        "suffix", F.lower(F.regexp_extract("file_name", r"[^.]\.([^.]+)\z", 1))
    )


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content, file_name, suffix for every file below ``path``."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select("path", "content")
    )
    return with_file_type(files)


def load_text_files(files: DataFrame) -> DataFrame:
    """TXT and CSV files as documents; ``files`` as from ``list_files``.

    Returns path, file_name, file_type, text (trimmed), characters (before
    trimming), rows and columns (CSV only).
    """
    decoded = files.where(F.col("suffix").isin("txt", "csv")).select(
        "path", "file_name", "suffix", decode_text(F.col("content")).alias("_raw")
    )
    is_csv = F.col("suffix") == "csv"
    flat = decoded.withColumn(
        "_delim", F.when(is_csv, infer_delimiter(F.col("_raw")))
    ).withColumn("_flat", F.when(is_csv, flatten_csv(F.col("_raw"), F.col("_delim"))))
    full = F.when(is_csv, F.col("_flat.text")).otherwise(F.col("_raw"))
    return flat.withColumn("_full", full).select(
        "path", "file_name", F.upper("suffix").alias("file_type"), strip(F.col("_full")).alias("text"),
        F.length("_full").alias("characters"), F.col("_flat.rows").alias("rows"),
        F.col("_flat.columns").alias("columns"),
    )


def rejected_files(files: DataFrame) -> DataFrame:
    """Files no loader takes, with the reason, instead of a failed job."""
    return files.where(~F.col("suffix").isin(*SUPPORTED)).select(
        "path", "file_name",
        F.lit("Unsupported file type. Please provide PDF, TXT, or CSV.").alias("reason"),
    )


def extract_pages(files: DataFrame, extractor) -> DataFrame:
    """Page table of PDF files through a user-supplied extractor.

    ``extractor`` maps an iterator of pandas frames (path, content) to frames
    (path, page_no, text); assemble the result with ``assemble_pages``.
    """
    return files.where(F.col("suffix") == "pdf").select("path", "content").mapInPandas(
        extractor, "path string, page_no int, text string"
    )


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of the text files below ``path``."""
    files = list_files(spark, path)
    return load_text_files(files), rejected_files(files)
