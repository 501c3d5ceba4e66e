"""Multi-document scans: batch metadata, virtual combined text, attribution.

A batch may hold a large share of all documents, so nothing here builds one
row, string or list per batch: counts are one row per batch, files and text
sections one row per document, whatever the size of the batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docwarden.operators.risk import section_header
from docwarden.operators.scale import ordered_prefix, salted_lookup

#: Documents of one block of a fingerprint. Part of the digest's definition.
FINGERPRINT_BLOCK = 4_096
#: Characters of a document that its analysis fingerprint covers by default.
FINGERPRINT_CHARS = 500


def _ranked(docs: DataFrame) -> DataFrame:
    """Add ``position``: number of earlier documents of the batch."""
    return ordered_prefix(docs, "batch_id", "doc_id", {"position": F.lit(1)})


def batch_totals(docs: DataFrame) -> DataFrame:
    """Files, types, characters and pages per batch (all map-side combined)."""
    return docs.groupBy("batch_id").agg(
        F.count("*").alias("files"),
        F.array_join(F.array_sort(F.collect_set("file_type")), ", ").alias("file_types"),
        F.sum("characters").alias("characters"),
        F.sum(F.coalesce("pages", F.lit(0))).alias("pages"),
    )


def batch_files(docs: DataFrame) -> DataFrame:
    """The ``file: status`` listing, one row per document.

    ``docs``: batch_id, doc_id, file_name, file_type, ocr_status (null when the
    file type has none).
    """
    status = F.coalesce("ocr_status", F.lit("not_applicable"))
    return docs.select(
        "batch_id", "doc_id", "file_name", "file_type", status.alias("ocr_status"),
        F.concat("file_name", F.lit(": "), status).alias("listing"),
    )


def source_ranges(docs: DataFrame) -> DataFrame:
    """Start and end of each document inside the combined text of its batch.

    ``docs``: batch_id, doc_id, file_name, file_type, characters. A batch of one
    document has no header, so its range starts at zero.
    """
    measured = docs.select(
        "batch_id", "doc_id", "file_name", F.length(section_header()).alias("_head"), "characters"
    )
    placed = ordered_prefix(
        measured, "batch_id", "doc_id",
        {"_before": F.col("_head") + F.col("characters"), "_position": F.lit(1)},
    )
    sizes = docs.groupBy("batch_id").agg(F.count("*").alias("_files"))
    joined = salted_lookup(placed, sizes, ["batch_id"], F.col("doc_id"), "inner")
    start = F.when(F.col("_files") > 1, F.col("_before") + F.col("_head")).otherwise(F.lit(0))
    return joined.select(
        "batch_id", "doc_id", "file_name",
        (start - F.when(F.col("_files") > 1, F.col("_head")).otherwise(0)).alias("section_start"),
        start.alias("start"), (start + F.col("characters")).alias("end"),
    )


def combine_text(docs: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """The combined text of each batch as sections, one per document.

    ``section`` is the document's header, if its batch has several documents,
    and its text; it begins at ``section_start`` of the combined text.
    """
    placed_at = (source_ranges(docs) if ranges is None else ranges).select(
        "doc_id", "section_start", "start"
    )
    section = F.when(
        F.col("start") > F.col("section_start"), F.concat(section_header(), F.col("text"))
    ).otherwise(F.col("text"))
    return docs.join(placed_at, "doc_id").select(
        "batch_id", "doc_id", "section_start", section.alias("section")
    )


def join_sections(sections: DataFrame) -> DataFrame:
    """One combined text per batch. Only for batches known to fit one row."""
    ordered = F.array_sort(F.collect_list(F.struct("section_start", "doc_id", "section")))
    return sections.groupBy("batch_id").agg(
        F.array_join(F.transform(ordered, lambda s: s["section"]), "").alias("text")
    )


def map_to_source(spans: DataFrame, ranges: DataFrame, width: int = 8_192) -> DataFrame:
    """Attribute combined-text offsets to files; both range ends are inclusive.

    Ranges are cut into tiles of ``width`` offsets, so the range condition
    becomes an equi-join on (batch, tile): a span only meets the files of its
    own tile and a huge batch spreads over many tiles. Where ranges touch, the
    earlier file wins; no match is ``Unknown``.
    """
    tiled = ranges.select(
        "batch_id", "file_name", F.col("start").alias("_from"), F.col("end").alias("_to"),
        F.explode(
            F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))
        ).alias("_tile"),
    )
    met = spans.withColumn("_tile", F.floor(F.col("start") / width)).join(
        tiled, ["batch_id", "_tile"], "left"
    )
    inside = F.col("start").between(F.col("_from"), F.col("_to"))
    return met.groupBy("batch_id", "start", "end", "category").agg(
        F.coalesce(
            F.min_by("file_name", F.when(inside, F.col("_from"))), F.lit("Unknown")
        ).alias("source")
    )


def batch_dashboard(docs: DataFrame) -> DataFrame:
    """Findings per document and which documents of the batch to review first.

    ``docs``: batch_id, doc_id, file_name, file_type, characters, n_findings.
    """
    most = docs.groupBy("batch_id").agg(F.max("n_findings").alias("_most"))
    joined = salted_lookup(docs, most, ["batch_id"], F.col("doc_id"), "inner")
    first = (F.col("n_findings") > 0) & (F.col("n_findings") == F.col("_most"))
    return joined.select(
        "batch_id", "doc_id", F.col("file_name").alias("document"),
        F.col("file_type").alias("type"), F.col("n_findings").alias("findings"), "characters",
        F.when(first, "Review first").otherwise("Normal review").alias("priority"),
    )


def _fingerprint(docs: DataFrame, piece: Column) -> DataFrame:
    """Digest of a batch from digests of its documents, in document order.

    Each document's binary piece is hashed; the hex digests of every
    ``FINGERPRINT_BLOCK`` consecutive documents are joined and hashed; the user
    id and the joined block digests are hashed again. The formula is the same
    for one document and for millions, and no task reads a whole batch.
    """
    leaves = _ranked(
        docs.select("batch_id", "user_id", "doc_id", F.sha2(piece, 256).alias("leaf"))
    )

    def joined(order: str, digest: str) -> Column:
        rows = F.array_sort(F.collect_list(F.struct(order, digest)))
        return F.array_join(F.transform(rows, lambda r: r[digest]), "")

    blocks = leaves.groupBy(
        "batch_id", "user_id", F.floor(F.col("position") / FINGERPRINT_BLOCK).alias("block")
    ).agg(F.sha2(joined("doc_id", "leaf"), 256).alias("digest"))
    return blocks.groupBy("batch_id", "user_id").agg(joined("block", "digest").alias("d")).select(
        "batch_id", "user_id",
        F.sha2(F.concat(F.col("user_id").cast("string"), "d"), 256).alias("fingerprint"),
    )


def upload_fingerprint(files: DataFrame) -> DataFrame:
    """Over user id, then name, byte length and content digest of each file."""
    name_and_size = F.concat("file_name", F.octet_length("content").cast("string"))
    piece = F.concat(name_and_size.cast("binary"), F.unhex(F.sha2("content", 256)))
    return _fingerprint(files, piece)


def analysis_fingerprint(docs: DataFrame, chars: int | None = FINGERPRINT_CHARS) -> DataFrame:
    """Over user id, then name, text length and first ``chars`` characters of each
    document; None takes the whole text."""
    head = F.col("text") if chars is None else F.left("text", F.lit(chars))
    piece = F.concat("file_name", F.length("text").cast("string"), head).cast("binary")
    return _fingerprint(docs, piece)


def persist_once(analyses: DataFrame, stored: DataFrame, *order: str) -> DataFrame:
    """Analyses whose id is not stored yet, the first row per id by ``order``.

    Without ``order`` the smallest row, all columns compared, is kept, so that
    reruns keep the same one.
    """
    columns = [c for c in analyses.columns if c != "analysis_id"]
    keys = [*order, *[c for c in columns if c not in order]]
    fresh = analyses.join(stored.select("analysis_id"), "analysis_id", "left_anti")
    if not keys:
        return fresh.distinct()
    first = fresh.groupBy("analysis_id").agg(F.min(F.struct(*keys)).alias("_row"))
    return first.select("analysis_id", *[F.col(f"_row.{c}") for c in columns]).select(
        *analyses.columns)


def first_per_group(rows: DataFrame, keys: list[str], order: list[Column], keep: int) -> DataFrame:
    """The first ``keep`` rows per group; Spark limits groups before shuffling."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).drop("_rn")
