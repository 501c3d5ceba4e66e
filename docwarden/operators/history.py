"""History and audit facts and the queries over them.

Facts are append-only tables. ``created_at`` ties are broken by ``id``,
descending. Latest-n lists are sort-plus-limit, which Spark runs as a bounded
top-n per partition, so no full sort takes place.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docwarden.operators.scale import salted_lookup

HISTORY_LIMIT = 50
AUDIT_LIMIT = 100
FEEDBACK_LIMIT = 200
TRACE_LIMIT = 200
ADMIN_LIMIT = 100


#: What is known about a file, by name and type. A type of file has only some of them.
METADATA = {
    "pages": "int", "characters": "int", "extraction_method": "string", "ocr_status": "string",
    "rows": "int", "columns": "int",
}


def metadata_payload(docs: DataFrame) -> Column:
    """A variant of those ``METADATA`` columns that ``docs`` has, without nulls."""
    there = [F.col(c) for c in METADATA if c in docs.columns]
    return F.parse_json(F.to_json(F.struct(*there)) if there else F.lit("{}"))


def metadata_field(name: str, payload: str = "metadata") -> Column:
    """One value of a payload, null where the payload has none or one of another type."""
    return F.try_variant_get(payload, f"$.{name}", METADATA[name])


def with_metadata(history: DataFrame, *names: str) -> DataFrame:
    """Add decoded payload columns, all by default."""
    return history.withColumns({name: metadata_field(name) for name in names or METADATA})


def history_rows(docs: DataFrame, batch_risk: DataFrame) -> DataFrame:
    """One row per document carrying the risk and counts of its whole batch.

    ``docs``: batch_id, doc_id, user_id, file_name, file_type, ocr_status,
    created_at, and any other ``METADATA`` columns, which become the payload.
    ``batch_risk``: ``assess_groups(scans, "batch_id")``.
    """
    risk = batch_risk.select(
        "batch_id", "risk_level", "risk_score", F.col("n_findings").alias("detections"),
        F.col("n_high").alias("high_severity_detections"),
        F.col("ranked").alias("categories"),
    )
    carried = docs.withColumn("metadata", metadata_payload(docs))
    joined = salted_lookup(carried, risk, ["batch_id"], F.col("doc_id"), "inner")
    return joined.select(
        F.col("doc_id").alias("id"), "batch_id", "user_id", "file_name", "file_type", "risk_level",
        "risk_score", "detections", "high_severity_detections", "categories",
        F.coalesce("ocr_status", F.lit("not_applicable")).alias("ocr_status"), "metadata", "created_at",
    )


def analysis_events(analyses: DataFrame) -> DataFrame:
    """``document_analyzed`` audit events, one per batch.

    ``analyses``: user_id, batch_id, file_count, first_file, risk_level,
    risk_score, detections, categories, created_at. A batch of one is named
    after its file; the files of larger ones are rows of ``batch_files``.
    """
    combined = F.when(F.col("file_count") == 1, F.col("first_file")).otherwise(
        "multi_document_analysis"
    )
    details = F.to_json(
        F.struct(
            "file_count", combined.alias("combined_file_name"), "risk_level",
            "risk_score", "detections", _category_map("categories").alias("categories"),
        )
    )
    return analyses.select(
        "user_id", "batch_id", F.lit("document_analyzed").alias("event_type"),
        details.alias("details"), "created_at",
    )


def _category_map(ranked: str) -> Column:
    return F.map_from_entries(
        F.transform(ranked, lambda r: F.struct(r["category"], r["n"]))
    )


def feedback_events(feedback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feedback rows with a trimmed note, and the audit events they cause."""
    from docwarden.functions.text import strip

    stored = feedback.withColumn("note", strip(F.coalesce("note", F.lit(""))))
    details = F.to_json(F.struct("analysis_id", "category", "verdict"))
    audits = stored.select(
        "user_id", F.lit("feedback_recorded").alias("event_type"), details.alias("details"),
        "created_at",
    )
    return stored, audits


def latest(
    rows: DataFrame, limit: int | None, order: str = "created_at", user_id: int | None = None
) -> DataFrame:
    """The latest rows, optionally of one user; without ``limit`` all of them, in no order."""
    if user_id is not None:
        rows = rows.where(F.col("user_id") == user_id)
    keys = [F.col(order).desc()] + ([F.col("id").desc()] if order != "id" else [])
    return rows if limit is None else rows.orderBy(*keys).limit(limit)


def user_documents(history: DataFrame, user_id: int, limit: int = HISTORY_LIMIT) -> DataFrame:
    return latest(history, limit, user_id=user_id).select(
        "id", "file_name", "file_type", "risk_level", "risk_score", "detections",
        "high_severity_detections", "categories", "ocr_status", "metadata", "created_at",
    )


def user_audits(audits: DataFrame, user_id: int, limit: int = AUDIT_LIMIT) -> DataFrame:
    return latest(audits, limit, user_id=user_id).select(
        "id", "event_type", "details", "created_at"
    )


def feedback_list(
    feedback: DataFrame, user_id: int | None = None, limit: int = FEEDBACK_LIMIT
) -> DataFrame:
    return latest(feedback, limit, "id", user_id)


def trace_list(
    traces: DataFrame, user_id: int | None = None, limit: int = TRACE_LIMIT
) -> DataFrame:
    return latest(traces, limit, "id", user_id)


def latest_per_user(rows: DataFrame, limit: int) -> DataFrame:
    """The same list for every user at once; groups are limited before the shuffle."""
    newest = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return rows.withColumn("row_no", F.row_number().over(newest)).where(F.col("row_no") <= limit)


def admin_totals(users: DataFrame, history: DataFrame, audits: DataFrame) -> DataFrame:
    """Four counts; each input is reduced to one row before they meet."""
    return (
        users.agg(F.count("*").alias("users"))
        .crossJoin(history.agg(
            F.count("*").alias("documents"),
            F.count_if(F.col("risk_level") == "High Risk").alias("high_risk_documents"),
        ))
        .crossJoin(audits.agg(F.count("*").alias("audits")))
    )


def admin_users(users: DataFrame, history: DataFrame, ordered: bool = True) -> DataFrame:
    """Users with their number of scans, newest first; history is counted before the join."""
    counts = history.groupBy(F.col("user_id").alias("_uid")).agg(F.count("*").alias("_n"))
    counted = users.join(counts, F.col("id") == F.col("_uid"), "left").select(
        *users.columns, F.coalesce("_n", F.lit(0)).alias("document_count")
    )
    return counted.orderBy(F.col("created_at").desc(), F.col("id").desc()) if ordered else counted


def _listed(rows: DataFrame, limit: int | None) -> DataFrame:
    """The latest rows, evaluated once: at most ``limit`` rows, a fixed small number."""
    newest = latest(rows, limit)
    if limit is None:
        return newest
    return rows.sparkSession.createDataFrame(newest.collect(), rows.schema)


#: How much more is taken when too few of the latest rows belong to known users, and how often.
WIDEN, WIDENINGS = 10, 3


def admin_documents(
    history: DataFrame, users: DataFrame, limit: int | None = ADMIN_LIMIT
) -> DataFrame:
    """Latest scans of known users with the user's e-mail.

    The newest ``limit`` scans nearly always have known users, so they are taken first, by a bounded
    top-n, and joined with the few users they name. Only if too few are left a larger top-n follows.
    After ``WIDENINGS`` of them unknown users are the rule, and history is filtered by users first.
    """
    names = users.select(F.col("id").alias("user_id"), "email")
    if limit is None:
        return salted_lookup(history, names, ["user_id"], F.col("id"), "inner")
    for step in range(WIDENINGS + 1):
        most = limit * WIDEN**step
        newest = _listed(history, most)
        known = _listed(newest.join(_named(newest, names), "user_id"), limit)
        if known.count() == limit or newest.count() < most:
            return known.select("user_id", *[c for c in history.columns if c != "user_id"], "email")
    joined = salted_lookup(history, names, ["user_id"], F.col("id"), "inner")
    return latest(joined, limit)


def _named(newest: DataFrame, names: DataFrame) -> DataFrame:
    """Those of ``names`` that a short list mentions; names are read without a shuffle."""
    return names.join(F.broadcast(newest.select("user_id").distinct()), "user_id", "left_semi")


def admin_audits(audits: DataFrame, users: DataFrame, limit: int = ADMIN_LIMIT) -> DataFrame:
    """Latest audit events with the e-mail where the user is known.

    A left join on a unique key never changes which events are latest, so the
    list is cut first. Users are then reduced to the at most ``limit`` ones that
    occur in it without being shuffled.
    """
    newest = _listed(audits, limit)
    named = _named(newest, users.select(F.col("id").alias("user_id"), "email"))
    return newest.join(F.broadcast(named), "user_id", "left")


def history_view(history: DataFrame, details: bool = False) -> DataFrame:
    """Display projection: categories as ``name: n`` text; with ``details`` the payload too."""
    shown = [metadata_field(c).alias(c.replace("_", " ").capitalize()) for c in METADATA
             if c != "ocr_status"] if details else []
    return history.select(
        F.col("created_at").alias("Date"), F.col("file_name").alias("Document"),
        F.col("file_type").alias("Type"), F.col("risk_level").alias("Risk"),
        F.col("risk_score").alias("Score"), F.col("detections").alias("Findings"),
        F.col("high_severity_detections").alias("High severity"),
        F.array_join(
            F.transform(
                "categories", lambda c: F.concat(c["category"], F.lit(": "), c["n"])
            ), ", ",
        ).alias("Categories"),
        F.col("ocr_status").alias("OCR"), *shown,
    )


def search_rows(view: DataFrame, text: str = "", risks: Iterable[str] | None = None) -> DataFrame:
    """Case-insensitive search in the JSON of the whole row, keys included."""
    out = view if risks is None else view.where(F.col("Risk").isin(list(risks)))
    if text:
        needle = F.lit(text.lower())
        row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in view.columns]))
        out = out.where(F.contains(F.lower(row), needle))
    return out


def history_metrics(history: DataFrame) -> DataFrame:
    return history.agg(
        F.count("*").alias("scans"),
        F.count_if(F.col("risk_level") == "High Risk").alias("high_risk"),
        F.coalesce(F.max_by("risk_score", F.struct("created_at", "id")), F.lit(0))
        .alias("latest_score"),
    )


def audit_view(audits: DataFrame, events: Iterable[str] | None = None) -> DataFrame:
    out = audits if events is None else audits.where(F.col("event_type").isin(list(events)))
    return out.select(
        F.col("created_at").alias("Date"), F.col("event_type").alias("Event"),
        F.col("details").alias("Details"),
    )


def audit_metrics(audits: DataFrame) -> DataFrame:
    return audits.agg(
        F.count("*").alias("events"),
        F.countDistinct("event_type").alias("event_types"),
        F.coalesce(F.max_by("event_type", F.struct("created_at", "id")), F.lit("-"))
        .alias("latest_event"),
    )


def ensure_column(rows: DataFrame, name: str, dtype: str, default=None) -> DataFrame:
    """Additive schema change: a missing column appears with its default."""
    if name in rows.columns:
        return rows
    return rows.withColumn(name, F.lit(default).cast(dtype))


def normalized_email(email: Column) -> Column:
    """Trimmed lower-case address, null when it has no ``@`` or no dot after it."""
    from docwarden.functions.text import strip

    clean = F.lower(strip(email))
    valid = F.contains(clean, F.lit("@")) & F.contains(
        F.substring_index(clean, "@", -1), F.lit(".")
    )
    return F.when(valid, clean)


def upsert_users(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """Merge profile rows into users by e-mail: a non-blank name wins.

    ``profiles``: email, full_name, auth_provider, provider_subject,
    last_login_at. Several rows per address collapse to the latest first; rows
    with an invalid address are left out.
    """
    clean = profiles.withColumn("email", normalized_email(F.col("email"))).where(
        F.col("email").isNotNull()
    )
    fields = ("full_name", "auth_provider", "provider_subject", "last_login_at")
    incoming = clean.groupBy("email").agg(
        F.max_by(F.struct(*fields), F.struct("last_login_at", "full_name")).alias("p"),
        F.max_by(
            "full_name", F.when(F.trim("full_name") != "", F.struct("last_login_at", "full_name"))
        ).alias("named"),
    )
    merged = users.join(incoming, "email", "full_outer")
    known = F.col("id").isNotNull()
    touched = F.col("p").isNotNull()
    return merged.select(
        "id", "email",
        F.coalesce(
            F.when(touched, F.nullif(F.trim("named"), F.lit(""))), F.col("full_name"), F.lit("")
        ).alias("full_name"),
        F.when(touched, F.col("p.auth_provider")).otherwise(F.col("auth_provider"))
        .alias("auth_provider"),
        F.when(touched, F.col("p.provider_subject")).otherwise(F.col("provider_subject"))
        .alias("provider_subject"),
        F.when(known, F.col("role")).otherwise("user").alias("role"),
        F.coalesce("created_at", F.col("p.last_login_at")).alias("created_at"),
        F.when(touched, F.col("p.last_login_at")).otherwise(F.col("last_login_at"))
        .alias("last_login_at"),
    )
