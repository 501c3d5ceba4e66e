"""Fact tables, logs and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.functions.masking import redacted
from docwarden.functions.text import escape_html, safe_file_name
from docwarden.operators.batches import batch_files


def scan_log(
    docs: DataFrame, batch_risk: DataFrame, created_at: str, users: DataFrame | None = None
) -> DataFrame:
    """Scan log lines: metadata and counts only, never raw values.

    One line per batch; its files are the rows of ``scan_log_files``. ``docs``:
    batch_id, doc_id, user_id, file_name, file_type, ocr_status. With ``users``
    (id, email) lines carry the address of the user.
    """
    heads = docs.groupBy("batch_id", "user_id").agg(
        F.array_sort(F.collect_set("file_type")).alias("file_types")
    )
    risk = batch_risk.select(
        "batch_id", F.col("n_documents").alias("file_count"),
        F.col("n_findings").alias("detections"),
        F.col("n_high").alias("high_severity_detections"), "ranked", "risk_level",
    )
    joined = heads.join(risk, "batch_id")
    email = F.lit(None).cast("string")
    if users is not None:
        known = users.select(F.col("id").alias("user_id"), F.col("email").alias("_email"))
        joined, email = joined.join(known, "user_id", "left"), F.col("_email")
    return joined.select(
        F.lit(created_at).alias("timestamp_utc"), "user_id", email.alias("user_email"), "batch_id",
        "file_count", "file_types", "detections", "high_severity_detections",
        F.map_from_entries(F.transform("ranked", lambda r: F.struct(r["category"], r["n"])))
        .alias("categories"),
        "risk_level",
    )


def scan_log_files(docs: DataFrame) -> DataFrame:
    """Names, types and OCR status of the files behind the log lines, a row each."""
    return batch_files(docs).select("batch_id", "doc_id", "file_name", "file_type", "ocr_status")


def write_jsonl(rows: DataFrame, path: str, run: str) -> None:
    """JSON lines of a run in a folder of its own; writing the run again replaces it."""
    rows.write.mode("overwrite").json(f"{path}/run={run}")


def rows_as_text(rows: DataFrame, number: str = "row_no") -> DataFrame:
    """Numbered ``key: value`` blocks, one output row per input row."""
    shown = [c for c in rows.columns if c != number]
    lines = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("None")))
             for c in shown]
    return rows.select(
        F.col(number),
        F.concat_ws("\n", F.concat(F.col(number).cast("string"), F.lit(".")), *lines).alias("value"),
    )


def rows_as_json(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and ``json``, the other columns as one object per row, nulls included."""
    shown = [F.col(f"`{c}`") for c in rows.columns if c not in keys]
    return rows.select(
        *keys, F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("json"))


def named_exports(rows: DataFrame, title: Column, ending: str) -> DataFrame:
    """Add ``export_name``: the title as a safe file name."""
    return rows.withColumn("export_name", F.concat(safe_file_name(title), F.lit(f".{ending}")))


def html_page(rows: DataFrame, title: str, text: str) -> DataFrame:
    """Add ``html``: a page with the escaped text of each row."""
    heading = escape_html(F.lit(title))
    return rows.withColumn(
        "html",
        F.concat(
            F.lit('<!doctype html>\n<html lang="en">\n<head><meta charset="utf-8"><title>'),
            heading, F.lit("</title></head>\n<body>\n<h1>"), heading, F.lit("</h1>\n<pre>"),
            escape_html(F.col(text)), F.lit("</pre>\n</body>\n</html>"),
        ),
    )


def write_text(rows: DataFrame, path: str, order: str | None = None) -> None:
    """Text files of the ``value`` column; with ``order``, in global order by file."""
    out = rows.orderBy(order) if order else rows
    out.select("value").write.mode("append").text(path)


def write_redacted(scans: DataFrame, path: str) -> None:
    """Redacted text per document; the original text is not written."""
    redacted(scans).select("doc_id", "file_name", "redacted_text").write.mode("append").parquet(
        path
    )
