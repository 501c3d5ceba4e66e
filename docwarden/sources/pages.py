"""Documents put together from page tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.functions.text import strip

MIN_TEXT = 50


def _joined(pages: DataFrame, label: str, name: str) -> DataFrame:
    """One row per document: page texts under their headers, in order."""
    section = F.concat(
        F.lit(f"\n--- {label} "), F.col("page_no").cast("string"), F.lit(" ---\n"),
        F.coalesce("text", F.lit("")),
    )
    ordered = F.array_sort(F.collect_list(F.struct("page_no", section.alias("section"))))
    return pages.groupBy("doc_id").agg(
        F.array_join(F.transform(ordered, lambda p: p["section"]), "\n").alias(name),
        F.count("*").alias(f"{name}_pages"),
    )


def assemble_pages(
    pages: DataFrame, ocr_pages: DataFrame | None = None, min_text: int = MIN_TEXT
) -> DataFrame:
    """doc_id, text, pages, characters, extraction_method, ocr_status, a row per document.

    ``pages`` and ``ocr_pages``: doc_id, page_no (from 1), text. OCR text takes
    over when the whole embedded text is shorter than ``min_text`` characters; a
    document that only has OCR pages has an empty embedded text. As elsewhere, a
    document's text is one row, so its pages are joined in one.
    """
    own = _joined(pages, "Page", "text")
    if ocr_pages is None:
        joined = own.withColumns({"_ocr": F.lit(None).cast("string"), "_ocr_pages": F.lit(0)})
    else:
        joined = own.join(_joined(ocr_pages, "OCR Page", "_ocr"), "doc_id", "full")
    own_text = F.coalesce("text", F.lit(""))
    short = F.length(strip(own_text)) < min_text
    use_ocr = short & (strip(F.coalesce("_ocr", F.lit(""))) != "")
    text = F.when(use_ocr, F.col("_ocr")).otherwise(own_text)
    return joined.select(
        "doc_id", strip(text).alias("text"),
        F.coalesce("text_pages", "_ocr_pages").alias("pages"),
        F.length(text).alias("characters"),
        F.when(use_ocr, "ocr").otherwise("embedded_text").alias("extraction_method"),
        _status(short).alias("ocr_status"),
    )


def _status(short: Column) -> Column:
    return (
        F.when(~short, "not_needed")
        .when(F.col("_ocr").isNotNull(), "completed")
        .otherwise("ocr_dependencies_missing")
    )
