"""Registered queries: (spark, table folder) -> DataFrame over whole tables.

Scan queries read ``documents`` through the enriched view, relational ones read
``orders`` as scan history, ``customer`` as users, ``events`` as audit events
and model traces, and ``labels`` as reviewer feedback.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarden.catalog import (
    CONFIDENTIAL_CATEGORY, DEFAULT_QUERY, DETECTORS, PATTERNS, CONTEXT_PATTERNS,
)
from docwarden.functions.masking import mask_value, redacted
from docwarden.functions.once import computed_once
from docwarden.functions.text import whole_percent
from docwarden.operators import (
    batches, compliance, detect, history, models, monitoring, nlp, qa, retrieval, risk, summary,
)
from docwarden.plans.enriched import enriched_documents
from docwarden.session import scratch_dir, stored
from docwarden.sources import files as file_source
from docwarden.sources import pages as page_source
from docwarden.sources import facts, sinks
from docwarden.sources.csv_text import flatten_csv, infer_delimiter
from docwarden.sources.tables import read_table
from docwarden.streaming import jobs, keyed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

QUESTIONS = (
    "",
    "How many email addresses are present?",
    "Count everything you found",
    "What sensitive data exists?",
    "What compliance issues are there?",
    "Please give me a summary",
    "What should we fix first?",
    "Write an audit note",
    "Can you mask the values?",
    "Any jailbreak text?",
    "Is the company phone listed?",
    "Show the credit card",
    "Which employee is named?",
    "Tell me something",
)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- inputs -----------------------------------------------------------------


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return detect.spread(enriched_documents(spark, d))


def _scans(spark: SparkSession, d: str) -> DataFrame:
    return detect.scan(_docs(spark, d))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return detect.explode_findings(_scans(spark, d))


def _assessed(spark: SparkSession, d: str) -> DataFrame:
    return risk.assess(_scans(spark, d))


def _summarized(spark: SparkSession, d: str) -> DataFrame:
    return summary.summarize(_assessed(spark, d))


def _joined(array: str, separator: str = "|") -> Column:
    return F.array_join(array, separator)


def _stamp(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def _doc_time(id_column: str = "doc_id") -> Column:
    """A made-up but fixed scan time per document."""
    return F.timestamp_seconds(F.lit(1704067200) + F.col(id_column) * 60)


def _users(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com"))
        .alias("email"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "admin").otherwise("user").alias("role"),
        F.timestamp_seconds(F.lit(1700000000) + F.col("c_nationkey") * 3600).alias("created_at"),
    )


def _history(spark: SparkSession, d: str) -> DataFrame:
    """Orders in the shape of scan history."""
    n = (F.col("o_orderkey") % 7).cast("int")
    return read_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
        F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"), F.lit(".csv"))
        .alias("file_name"),
        F.lit("CSV").alias("file_type"),
        F.when(F.col("o_orderstatus") == "F", "High Risk")
        .when(F.col("o_orderstatus") == "O", "Medium Risk").otherwise("Low Risk")
        .alias("risk_level"),
        F.least(F.lit(100), F.floor(F.col("o_totalprice") / 5000)).cast("int").alias("risk_score"),
        n.alias("detections"), F.floor(n / 2).cast("int").alias("high_severity_detections"),
        F.array(
            F.struct(F.col("o_orderpriority").alias("category"), n.alias("n"))
        ).alias("categories"),
        F.lit("not_applicable").alias("ocr_status"),
        F.parse_json(F.to_json(F.struct((n + 1).alias("rows"), F.lit(3).alias("columns")))).alias("metadata"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def _audits(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").select(
        F.col("event_id").alias("id"), "user_id", "event_type", F.col("props").alias("details"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def _trace_rows(events: DataFrame) -> DataFrame:
    """Events in the shape of model calls, as trace facts."""
    calls = events.select(
        F.col("event_id").alias("id"), "user_id",
        F.concat(F.lit("a"), F.col("user_id").cast("string")).alias("analysis_id"),
        F.when(F.col("event_type") == "view", "qa").otherwise("summary").alias("feature"),
        F.lit("groq").alias("provider"), F.lit("test-model").alias("model"),
        (F.col("event_type") != "signup").alias("has_key"),
        F.when(F.col("event_type") == "error", "Rules fallback (timeout)")
        .otherwise("Enhanced analysis").alias("status"),
        F.floor(F.col("value") * 10).cast("int").alias("latency_ms"),
        F.col("props").alias("output"), F.col("ts").cast("timestamp").alias("created_at"),
    )
    return monitoring.trace_rows(calls)


def _traces(spark: SparkSession, d: str) -> DataFrame:
    return _trace_rows(read_table(spark, d, "events"))


def _feedback(spark: SparkSession, d: str) -> DataFrame:
    verdict = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "Correct")
        .when(F.col("quality") == 0, "False positive").otherwise("Missed sensitive data")
    )
    names = F.array(*[F.lit(p.category) for p in PATTERNS])
    raw = read_table(spark, d, "labels").select(
        F.col("doc_id").alias("id"), (F.col("doc_id") % 50).alias("user_id"),
        F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("analysis_id"),
        names[(F.col("doc_id") % len(PATTERNS)).cast("int")].alias("category"),
        F.lit("AB****4F").alias("masked_value"), verdict.alias("verdict"),
        F.concat(F.lit("  seen "), F.col("doc_id").cast("string"), F.lit(" \n")).alias("note"),
        _doc_time().alias("created_at"),
    )
    return history.feedback_events(raw)[0]


def _measured(spark: SparkSession, d: str) -> DataFrame:
    """Narrow document rows for batch operators."""
    return _docs(spark, d).select(
        "batch_id", "doc_id", "user_id", "file_name", "file_type",
        F.length("text").alias("characters"), (F.col("doc_id") % 4).cast("int").alias("pages"),
        F.when(F.col("doc_id") % 3 == 0, "not_needed").when(F.col("doc_id") % 3 == 1, "completed")
        .alias("ocr_status"),
        _doc_time().alias("created_at"),
    )


# --- detection --------------------------------------------------------------


@query
def raw_email_spans(spark, d):
    docs = detect.spread(read_table(spark, d, "documents").select("doc_id", "text"))
    return detect.explode_findings(detect.scan(docs, ["Email Address"]), "doc_id").select(
        "doc_id", "value", "start", "end"
    )


@query
def raw_card_luhn(spark, d):
    docs = detect.spread(read_table(spark, d, "documents").select("doc_id", "text"))
    return detect.explode_findings(detect.scan(docs, ["Credit Card Number"]), "doc_id").select(
        "doc_id", "value", "start", "end"
    )


@query
def conversation_findings(spark, d):
    turns = read_table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "role", "text"
    )
    return detect.explode_findings(detect.scan(detect.spread(turns)), "doc_id", "role").select(
        "doc_id", "role", "category", "start", "end"
    )


@query
def page_findings(spark, d):
    html = read_table(spark, d, "pages").select(
        F.col("page_id").alias("doc_id"), F.col("html").alias("text")
    )
    return detect.explode_findings(detect.scan(detect.spread(html)), "doc_id").select(
        "doc_id", "category", "value", "start", "end"
    )


def _span_query(category: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = detect.candidates(_docs(spark, d), [category]).select(
            "doc_id", F.explode_outer("candidates").alias("c")
        )
        return found.where(F.col("c.s").isNotNull()).select(
            "doc_id", F.col("c.s").alias("start"), F.col("c.e").alias("end"),
            F.col("c.v").alias("value"),
        )

    return run


def span_key(category: str) -> str:
    return "span_" + "_".join("".join(ch if ch.isalnum() else " " for ch in category).lower().split())


SPAN_CATEGORIES = tuple(
    dict.fromkeys(d.category for d in DETECTORS)
)
for _category in SPAN_CATEGORIES:
    QUERIES[span_key(_category)] = _span_query(_category)


@query
def findings(spark, d):
    return _facts(spark, d).select(
        "doc_id", "category", "value", "start", "end", "severity", "confidence", "reason"
    )


@query
def findings_view(spark, d):
    return detect.findings_view(_facts(spark, d))


@query
def findings_filtered(spark, d):
    facts = detect.filter_findings(
        _facts(spark, d), categories=["PAN Number", "Email Address", "Password"],
        severities=["High"],
    )
    return facts.select("doc_id", "category", mask_value(F.col("value")).alias("masked_value"))


@query
def filter_options(spark, d):
    return detect.filter_options(_facts(spark, d))


@query
def findings_by_category(spark, d):
    totals = risk.category_totals(_facts(spark, d))
    return totals.select(
        "category", "n", F.col("first.doc_id").alias("first_doc"), "ratio"
    )


@query
def findings_by_source(spark, d):
    return risk.category_totals(_facts(spark, d), "source").select(
        "source", "category", "n", "ratio"
    )


# --- masking ----------------------------------------------------------------


def _marked_words():
    """A stand-in for an entity model: two marked words and a code that detectors know as well."""
    import re

    labels = {"Badge": "ORG", "Reference": "PERSON", "HDFC0": "ORG", "Bengaluru": "GPE"}
    pattern = re.compile("|".join(labels))
    return lambda text: [(labels[m[0]], m[0], m.start(), m.end()) for m in pattern.finditer(text)]


@query
def model_entities(spark, d):
    """Findings with those of an entity model that none of them covers."""
    merged = detect.with_model_entities(_scans(spark, d), _marked_words, window=1_000, overlap=100)
    return detect.explode_findings(merged, "doc_id").select("doc_id", "category", "value", "start", "end", "reason")


@query
def masked_findings(spark, d):
    return _facts(spark, d).select(
        "doc_id", "start", mask_value(F.col("value")).alias("masked_value")
    )


@query
def redacted_docs(spark, d):
    return redacted(_scans(spark, d)).select("doc_id", F.md5("redacted_text").alias("digest"),
                                             F.length("redacted_text").alias("length"))


@query
def redacted_context(spark, d):
    return redacted(_scans(spark, d)).select(
        "doc_id", F.left("redacted_text", F.lit(models.CONTEXT_CHARS)).alias("context")
    )


@query
def before_after(spark, d):
    return redacted(_scans(spark, d)).select(
        "doc_id", "file_name", F.sha2("text", 256).alias("original"),
        F.sha2("redacted_text", 256).alias("redacted"),
    )


# --- risk -------------------------------------------------------------------


@query
def risk_by_doc(spark, d):
    return _assessed(spark, d).select(
        "doc_id", "risk_score", "risk_level", "n_findings", "n_high",
        F.size("categories").alias("n_categories"),
    )


@query
def scan_summary(spark, d):
    """Documents, findings and mean score per language and risk level."""
    return _assessed(spark, d).groupBy("lang", "risk_level").agg(
        F.count("*").alias("documents"), F.sum("n_findings").alias("findings"),
        F.sum("risk_score").alias("total_score"), F.max("risk_score").alias("top_score"),
    )


@query
def risk_reasons(spark, d):
    return _assessed(spark, d).select("doc_id", _joined("risk_reasons").alias("reasons"))


def _group_risk(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    return risk.assess_groups(_scans(spark, d), *keys).select(
        *keys, "n_documents", "n_findings", "n_high", "n_chars", "risk_score", "risk_level",
        F.expr(risk.category_map_text()).alias("ranked"),
    )


@query
def risk_by_batch(spark, d):
    return _group_risk(spark, d, "batch_id")


@query
def risk_by_source(spark, d):
    return _group_risk(spark, d, "source")


@query
def risk_by_lang(spark, d):
    return _group_risk(spark, d, "lang")


@query
def category_top(spark, d):
    return _assessed(spark, d).select(
        "doc_id", F.expr(risk.category_map_text(limit=5)).alias("top_categories")
    )


@query
def severity_totals(spark, d):
    return risk.severity_totals(_facts(spark, d), "lang")


@query
def corpus_metrics(spark, d):
    return risk.corpus_metrics(_assessed(spark, d))


# --- summary ----------------------------------------------------------------


@query
def doc_profile(spark, d):
    return summary.document_profile(_docs(spark, d)).select("doc_id", "profile")


@query
def doc_excerpt(spark, d):
    return summary.document_excerpt(_docs(spark, d)).select("doc_id", "excerpt")


@query
def observations(spark, d):
    return _summarized(spark, d).select("doc_id", _joined("observations").alias("observations"))


@query
def security_risks(spark, d):
    return _summarized(spark, d).select("doc_id", _joined("security_risks").alias("risks"))


@query
def remediation(spark, d):
    return _summarized(spark, d).select("doc_id", _joined("remediation").alias("steps"))


@query
def extract_summary(spark, d):
    return _summarized(spark, d).select("doc_id", "extract_summary")


@query
def summary_text(spark, d):
    return _summarized(spark, d).select(
        "doc_id", F.md5(F.expr(summary.summary_text("'Standard analysis'"))).alias("digest")
    )


# --- questions --------------------------------------------------------------


@query
def qa_router(spark, d):
    return qa.answer_all(_summarized(spark, d), QUESTIONS).select(
        "doc_id", F.col("question_id").cast("bigint").alias("question_id"), "answer"
    )


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "labels").select(
        "doc_id", F.col("doc_id").alias("question_id"),
        F.array(*[F.lit(x) for x in QUESTIONS])[(F.col("doc_id") % len(QUESTIONS)).cast("int")]
        .alias("question"),
    )


@query
def qa_questions(spark, d):
    """Questions as a table: every labelled document asks one."""
    asked = _asked(spark, d)
    docs = _docs(spark, d).join(asked.select("doc_id"), "doc_id", "left_semi")
    summarized = summary.summarize(risk.assess(detect.scan(docs)))
    return qa.answer_questions(asked, summarized).select(
        "doc_id", "matched_category", "is_local", "answer"
    )


@query
def qa_category(spark, d):
    return qa.answer_all(_summarized(spark, d), QUESTIONS).select(
        "doc_id", F.col("question_id").cast("bigint").alias("question_id"), "matched_category"
    )


@query
def qa_audit_note(spark, d):
    return qa.answer_all(_summarized(spark, d), ["Write an audit note"]).select("doc_id", "answer")


@query
def qa_local_flag(spark, d):
    """The local-question test over every conversation turn."""
    turns = read_table(spark, d, "conversations")
    asked = turns.select("conv_id", "turn", F.lower("text").alias("_q"))
    return asked.select("conv_id", "turn", F.expr(qa._local_sql()).alias("is_local"))


@query
def latest_turns(spark, d):
    turns = read_table(spark, d, "conversations").withColumnRenamed("conv_id", "session_id")
    return qa.latest_turns(turns).select("session_id", "turn", "role", "position")


@query
def question_evidence(spark, d):
    asked = _asked(spark, d)
    docs = _docs(spark, d).join(asked.select("doc_id"), "doc_id", "left_semi")
    safe = redacted(detect.scan(docs)).select("doc_id", F.col("redacted_text").alias("text"))
    return retrieval.question_evidence(asked, safe).select("doc_id", "rank", "chunk_no", "text")


# --- text -------------------------------------------------------------------


def _redacted_as_text(spark: SparkSession, d: str) -> DataFrame:
    return redacted(_scans(spark, d)).select("doc_id", F.col("redacted_text").alias("text"))


@query
def keyword_signals(spark, d):
    return nlp.keyword_signals(_redacted_as_text(spark, d))


@query
def ruler_signals(spark, d):
    return nlp.ruler_signals(_docs(spark, d).select("doc_id", "text"))


@query
def ruler_signals_redacted(spark, d):
    """Phrases that are left once sensitive values are gone."""
    return nlp.ruler_signals(_redacted_as_text(spark, d))


@query
def chunks(spark, d):
    return nlp.chunk_text(_docs(spark, d))


@query
def sentence_chunks(spark, d):
    return nlp.chunk_sentences(_docs(spark, d))


@query
def terms(spark, d):
    """Document and occurrence counts of every term."""
    counted = retrieval.document_terms(_docs(spark, d)).groupBy("term", "doc_id").agg(
        F.count("*").alias("n")
    )
    return counted.groupBy("term").agg(
        F.sum("n").alias("occurrences"), F.count("*").alias("documents")
    )


@query
def compact_text(spark, d):
    return nlp.semantic_input(_docs(spark, d))


@query
def hash_vectors(spark, d):
    rows = retrieval.hash_vectors(read_table(spark, d, "benchmark").select(
        F.col("item_id").alias("doc_id"), "text"
    ).unionByName(_docs(spark, d).select("doc_id", "text").withColumn(
        "doc_id", F.col("doc_id") + 1_000_000_000)))
    return rows.select("doc_id", "chunk_no", "dim", F.round("w", 6).alias("w"))


def _contexts(rows: DataFrame) -> DataFrame:
    return retrieval.context_rows(rows).select(
        "doc_id", "rank", "chunk_no", F.round("score", 6).alias("score")
    )


@query
def retrieve_top4(spark, d):
    return _contexts(retrieval.retrieve(_docs(spark, d), DEFAULT_QUERY, 4))


@query
def lexical_top4(spark, d):
    return _contexts(retrieval.retrieve_lexical(_docs(spark, d), DEFAULT_QUERY, 4))


@query
def policy_evidence(spark, d):
    policies = detect.spread(
        read_table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    )
    return retrieval.policy_evidence(policies).select("doc_id", "rank", "text")


@query
def vector_topk(spark, d):
    vectors = read_table(spark, d, "embeddings").select(
        F.col("label").alias("collection"), "vec_id", "embedding"
    )
    return retrieval.vector_topk(vectors, retrieval.centroids(vectors, 64), 5).select(
        "collection", "vec_id", "rank", F.round("score", 6).alias("score")
    )


@query
def vector_topk_queries(spark, d):
    """Several queries per collection: its vectors with an id divisible by 25."""
    vectors = read_table(spark, d, "embeddings").select(F.col("label").alias("collection"), "vec_id", "embedding")
    asked = vectors.where("vec_id % 25 = 0").select(
        "collection", F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.vector_topk(vectors, asked, 4).select(
        "collection", "query_id", "vec_id", "rank", F.round("score", 6).alias("score")
    )


# --- compliance -------------------------------------------------------------


@query
def framework_map(spark, d):
    return compliance.framework_map(_assessed(spark, d))


@query
def heatmap(spark, d):
    return compliance.risk_heatmap(_assessed(spark, d))


@query
def heatmap_placeholder(spark, d):
    """The row shown for documents without findings."""
    clean = _assessed(spark, d).where("n_findings = 0")
    return compliance.heatmap_or_placeholder(compliance.risk_heatmap(clean))


@query
def severity_rows(spark, d):
    return compliance.severity_explanations(_scans(spark, d))


@query
def actions(spark, d):
    return compliance.recommended_actions(_facts(spark, d)).groupBy("category", "next_action").agg(
        F.count("*").alias("n")
    )


@query
def action_plan(spark, d):
    return compliance.action_plan(_assessed(spark, d))


@query
def review_rows(spark, d):
    return compliance.reviewer_workflow(_assessed(spark, d))


@query
def policy_check(spark, d):
    """Every document against the policy texts of its batch; every item is used."""
    items = read_table(spark, d, "benchmark").select(
        (F.col("item_id") % 40).alias("policy_id"), "item_id",
        F.when(F.col("item_id") % 3 == 1,
               F.concat(F.col("text"), F.lit(" Redact and restrict sensitive fields before use.")))
        .otherwise(F.col("text")).alias("text"),
    )
    # the policy of a batch is made of all items with its number, a bounded few of them
    ordered = F.array_sort(F.collect_list(F.struct("item_id", "text")))
    policies = items.groupBy("policy_id").agg(
        F.array_join(F.transform(ordered, lambda i: i["text"]), "\n").alias("text")
    )
    docs = _assessed(spark, d).withColumn("policy_id", F.col("batch_id"))
    return compliance.policy_check(docs, policies)


@query
def policy_catalogue_use(spark, d):
    """Findings of the whole corpus per catalogue policy they trigger."""
    names = {
        "DPDP India": ("Aadhaar Number", "PAN Number", "Date of Birth", "Address / Location"),
        "PCI-style payment safety": ("Credit Card Number", "Bank Account Number"),
        "Credential exposure": ("API Key", "Password"),
        "Confidential business": (CONFIDENTIAL_CATEGORY, "Confidential Project Name"),
        "AI prompt-injection guardrail": ("Prompt Injection Attempt",),
    }
    pairs = F.create_map(
        *[F.lit(x) for name, cats in names.items() for c in cats for x in (c, name)]
    )
    counts = _facts(spark, d).select(
        F.try_element_at(pairs, F.col("category")).alias("policy")
    ).groupBy("policy").agg(F.count("*").alias("n"))
    catalogue = compliance.policy_catalogue(spark)
    return catalogue.join(F.broadcast(counts), "policy", "left").select(
        "policy", "control", F.coalesce("n", F.lit(0)).alias("n")
    )


@query
def final_report(spark, d):
    return compliance.final_report(_summarized(spark, d)).select(
        "doc_id", F.length("report").alias("length"), F.md5("report").alias("digest")
    )


@query
def reviewer_decisions(spark, d):
    decisions = _assessed(spark, d).select(
        "user_id", F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("analysis_id"),
        F.when(F.col("doc_id") % 5 == 4, "Unknown")
        .otherwise(F.array(*[F.lit(s) for s in ("Open", "In progress", "Fixed", "Accepted risk")])[
            (F.col("doc_id") % 4).cast("int")]).alias("status"),
        F.lit("Compliance reviewer").alias("owner"), F.lit("checked").alias("note"),
        F.col("risk_level").alias("risk"), F.col("n_findings").alias("detections"),
        _doc_time().alias("created_at"),
    )
    return compliance.record_decisions(decisions).select(
        "user_id", "event_type", "details", _stamp("created_at").alias("created_at")
    )


# --- history and audit ------------------------------------------------------


def _scan_history(spark: SparkSession, d: str) -> DataFrame:
    return history.history_rows(
        _measured(spark, d), risk.assess_groups(_scans(spark, d), "batch_id")
    )


@query
def history_facts(spark, d):
    return _scan_history(spark, d).select(
        "id", "batch_id", "user_id", "file_name", "risk_level", "risk_score", "detections",
        "high_severity_detections", F.expr(risk.category_map_text("categories")).alias("categories"),
        "ocr_status", _stamp("created_at").alias("created_at"),
    )


def _payload_history(spark: SparkSession, d: str) -> DataFrame:
    """Scan history whose files are text, paged or tabular in turn, appended twice by one run."""
    kind = F.col("doc_id") % 3
    docs = _measured(spark, d).withColumns({
        "file_type": F.when(kind == 0, "TXT").when(kind == 1, "PDF").otherwise("CSV"),
        "pages": F.when(kind == 1, F.col("pages")),
        "extraction_method": F.when(kind == 1, "embedded_text"),
        "ocr_status": F.when(kind == 1, F.col("ocr_status")),
        "rows": F.when(kind == 2, (F.col("characters") % 90).cast("int")),
        "columns": F.when(kind == 2, (F.col("doc_id") % 7).cast("int")),
    })
    written = stored(history.history_rows(docs, risk.assess_groups(_scans(spark, d), "batch_id")))
    folder = f"{scratch_dir(spark)}/history"
    for _ in range(2):
        facts.append_facts(written, folder, "first")
    return facts.read_facts(spark, folder, written.schema)


@query
def history_payload(spark, d):
    """Typed values of the payload, back from the table that was written twice."""
    return history.with_metadata(_payload_history(spark, d).drop("ocr_status")).select(
        "id", "file_type", "risk_level", *history.METADATA,
        F.col("created_date").cast("string").alias("created_date"), "run",
    )


@query
def history_payload_search(spark, d):
    """Files found by a value of their payload."""
    view = history.history_view(_payload_history(spark, d), details=True)
    return history.search_rows(view, '"Extraction method":"EMBEDDED_TEXT"').select(
        F.col("Document").alias("document"), F.col("Pages").alias("pages"), F.col("Characters").alias("characters"),
    )


@query
def fact_generations(spark, d):
    """Users written before and after columns were added, read with what the columns meant before."""
    users = _users(spark, d)
    folder = f"{scratch_dir(spark)}/users"
    facts.append_facts(users.where("id % 2 = 0").drop("full_name"), folder, "old")
    facts.append_facts(users.where("id % 2 = 1").withColumns({
        "auth_provider": F.when(F.col("id") % 3 == 0, "google"), "logins": F.col("id") % 5}), folder, "new")
    return facts.read_facts(
        spark, folder, "id bigint, email string, full_name string, auth_provider string",
        {"full_name": "''", "auth_provider": "'password'"},
    ).select("id", "email", "full_name", "auth_provider", "role", "logins")


@query
def facts_by_date(spark, d):
    """History of some days, read from those days' folders."""
    folder = f"{scratch_dir(spark)}/days"
    rows = _history(spark, d).select("id", "user_id", "risk_level", "created_at").withColumn(
        "created_at", F.date_trunc("year", "created_at"))
    facts.append_facts(rows, folder, "r")
    return facts.read_facts(spark, folder, rows.schema, since="1994-01-01", until="1996-12-31").select(
        "id", "risk_level", F.col("created_date").cast("string").alias("created_date"))


def _logged(spark: SparkSession, d: str) -> DataFrame:
    return _measured(spark, d).withColumn("user_id", F.col("batch_id"))


@query
def scan_log(spark, d):
    users = read_table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.concat(F.col("c_name"), F.lit("@example.com")).alias("email")
    )
    log = sinks.scan_log(
        _logged(spark, d), risk.assess_groups(_scans(spark, d), "batch_id"),
        "2024-01-01T00:00:00Z", users,
    )
    return log.select(
        "timestamp_utc", "batch_id", "user_email", "file_count",
        _joined("file_types", ",").alias("types"), "detections", "high_severity_detections",
        F.expr("aggregate(map_values(categories), 0L, (a, x) -> a + x)").alias("category_total"),
        "risk_level",
    )


@query
def scan_log_files(spark, d):
    return sinks.scan_log_files(_logged(spark, d))


@query
def analysis_events(spark, d):
    first = _logged(spark, d).groupBy("user_id", "batch_id").agg(
        F.min_by("file_name", "doc_id").alias("first_file")
    )
    per_batch = risk.assess_groups(_scans(spark, d), "batch_id").select(
        "batch_id", "risk_level", "risk_score", F.col("n_findings").alias("detections"),
        F.col("ranked").alias("categories"), F.col("n_documents").alias("file_count"),
    )
    analyses = first.join(per_batch, "batch_id").withColumn(
        "created_at", F.lit("2024-01-01 00:00:00").cast("timestamp")
    )
    return history.analysis_events(analyses).select(
        "batch_id", "event_type",
        F.get_json_object("details", "$.combined_file_name").alias("combined"),
        F.get_json_object("details", "$.file_count").cast("bigint").alias("file_count"),
        F.get_json_object("details", "$.detections").cast("bigint").alias("detections"),
        F.get_json_object("details", "$.risk_level").alias("risk_level"),
    )


@query
def user_documents(spark, d):
    return history.user_documents(_history(spark, d), 7).select(
        "id", "file_name", "risk_level", "risk_score", history.metadata_field("rows").alias("rows"),
        history.metadata_field("columns").alias("columns"), _stamp("created_at").alias("created_at")
    )


@query
def user_documents_all(spark, d):
    return history.latest_per_user(_history(spark, d), 3).select("user_id", "row_no", "id")


@query
def user_audits(spark, d):
    return history.user_audits(_audits(spark, d), 7).select(
        "id", "event_type", F.get_json_object("details", "$.k").alias("k"),
        _stamp("created_at").alias("created_at"),
    )


@query
def feedback_list(spark, d):
    return history.feedback_list(_feedback(spark, d)).select(
        "id", "user_id", "analysis_id", "category", "verdict", "note",
        _stamp("created_at").alias("created_at"),
    )


@query
def feedback_audits(spark, d):
    audits = history.feedback_events(_feedback(spark, d))[1]
    return audits.select("user_id", "event_type", "details")


@query
def trace_list(spark, d):
    return history.trace_list(_traces(spark, d)).select(
        "id", "user_id", "feature", "model_provider", "model_name", "prompt_version", "status",
        "latency_ms", "output_hash",
    )


@query
def trace_list_user(spark, d):
    return history.trace_list(_traces(spark, d), 8).select("id", "status", "output_hash")


@query
def admin_totals(spark, d):
    return history.admin_totals(_users(spark, d), _history(spark, d), _audits(spark, d))


@query
def admin_users(spark, d):
    return history.admin_users(_users(spark, d), _history(spark, d)).select(
        "id", "full_name", "email", "role", _stamp("created_at").alias("created_at"),
        "document_count",
    )


@query
def admin_documents(spark, d):
    return history.admin_documents(_history(spark, d), _users(spark, d)).select(
        "id", "file_name", "risk_level", "email", _stamp("created_at").alias("created_at")
    )


@query
def admin_audits(spark, d):
    return history.admin_audits(_audits(spark, d), _users(spark, d)).select(
        "id", "event_type", "email", _stamp("created_at").alias("created_at")
    )


@query
def history_search(spark, d):
    view = history.history_view(_history(spark, d)).withColumn("Date", _stamp("Date"))
    return history.search_rows(view, "2-HIGH: 3", ["High Risk", "Low Risk"]).select(
        F.col("Document").alias("document"), F.col("Risk").alias("risk"),
        F.col("Categories").alias("categories_text"),
    )


@query
def history_metrics(spark, d):
    return history.history_metrics(_history(spark, d))


@query
def audit_metrics(spark, d):
    return history.audit_metrics(_audits(spark, d))


@query
def audit_view(spark, d):
    return history.audit_view(_audits(spark, d), ["error", "signup"]).select(
        _stamp("Date").alias("created"), F.col("Event").alias("event"),
        F.col("Details").alias("details"),
    )


@query
def upsert_users(spark, d):
    profiles = _users(spark, d).where(F.col("role") == "admin").select(
        F.concat(F.lit(" "), F.upper("email")).alias("email"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("New "), F.col("full_name")))
        .otherwise("  ").alias("full_name"),
        F.lit("google").alias("auth_provider"), F.lit("s").alias("provider_subject"),
        F.lit("2024-02-01 00:00:00").cast("timestamp").alias("last_login_at"),
    )
    late = read_table(spark, d, "supplier").select(
        F.concat(F.lit("supplier"), F.col("s_suppkey").cast("string"),
                 F.when(F.col("s_suppkey") % 4 == 0, "").otherwise("@example.org")).alias("email"),
        F.col("s_name").alias("full_name"), F.lit("github").alias("auth_provider"),
        F.lit("x").alias("provider_subject"),
        F.lit("2024-02-02 00:00:00").cast("timestamp").alias("last_login_at"),
    )
    users = _users(spark, d)
    for name, dtype, default in (("auth_provider", "string", "password"),
                                 ("provider_subject", "string", None),
                                 ("last_login_at", "timestamp", None)):
        users = history.ensure_column(users, name, dtype, default)
    return history.upsert_users(users, profiles.unionByName(late)).select(
        "id", "email", "full_name", "auth_provider", "role",
        _stamp("last_login_at").alias("last_login_at"),
    )


# --- monitoring -------------------------------------------------------------


def _rounded_metrics(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {"precision": F.round("precision", 6), "coverage": F.round("coverage", 6)}
    )


@query
def feedback_metrics(spark, d):
    return _rounded_metrics(monitoring.feedback_metrics(_feedback(spark, d)))


@query
def feedback_by_category(spark, d):
    return _rounded_metrics(monitoring.feedback_metrics(_feedback(spark, d), "category"))


@query
def trace_monitoring(spark, d):
    return monitoring.trace_monitoring(_traces(spark, d))


@query
def trace_monitoring_empty(spark, d):
    """The row shown while no call has failed by name."""
    return monitoring.trace_monitoring(_traces(spark, d).where("status = 'No such status'"))


@query
def governance(spark, d):
    return monitoring.governance_metrics(_assessed(spark, d))


@query
def stage_trace(spark, d):
    return monitoring.stage_trace(_assessed(spark, d))


@query
def feedback_view(spark, d):
    view = monitoring.feedback_view(_feedback(spark, d))
    return view.select(
        _stamp("Date").alias("created"), F.col("Category").alias("category"),
        F.col("Verdict").alias("verdict"), F.col("Note").alias("note"),
    )


@query
def trace_view(spark, d):
    view = monitoring.trace_view(_traces(spark, d))
    return view.groupBy(
        F.col("Feature").alias("feature"), F.col("Provider").alias("provider"),
        F.col("Status").alias("status"),
    ).agg(F.count("*").alias("n"), F.max("Latency ms").alias("top_latency"))


# --- model outputs ----------------------------------------------------------


@query
def context_pack(spark, d):
    packed = models.prepare_context(_assessed(spark, d))
    masked = "array_join(transform(masked_findings, f -> concat(f.category, '=', f.masked_value)), '|')"
    return packed.select(
        "doc_id", F.expr(masked).alias("masked"), F.md5("redacted_context").alias("digest"),
        F.expr("array_join(transform(context, c -> cast(c.chunk_no AS string)), ',')")
        .alias("chunk_list"),
    )


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    return models.prepare_context(_assessed(spark, d))


@query
def summary_prompts(spark, d):
    prompts = models.build_summary_prompt(_prepared(spark, d))
    return prompts.select("doc_id", F.length("prompt").alias("length"), F.md5("prompt").alias("digest"))


@query
def question_prompts(spark, d):
    questions = F.array(*[F.lit(x) for x in QUESTIONS])
    asked = _prepared(spark, d).withColumn("question", questions[(F.col("doc_id") % len(QUESTIONS)).cast("int")])
    prompts = models.build_question_prompt(asked)
    return prompts.select("doc_id", F.length("prompt").alias("length"), F.md5("prompt").alias("digest"))


def _model_items(spark: SparkSession, d: str) -> DataFrame:
    """Two made-up models per document: the rules' output, and a louder copy of it."""
    rows = _summarized(spark, d).select(
        F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("analysis_id"),
        F.inline(F.array(
            *[F.struct(F.lit(m).alias("model_no"), F.lit(s).alias("section"), F.col(c).alias("items"))
              for m in (0, 1)
              for s, c in (("Compliance observations", "observations"),
                           ("Security risks", "security_risks"),
                           ("Suggested remediation steps", "remediation"))]
        )),
    ).select("analysis_id", "model_no", "section", F.posexplode("items").alias("pos", "item"))
    louder = F.concat(F.upper("item"), F.when(F.col("pos") == 1, " AND MORE").otherwise("!!"))
    return rows.withColumn("item", F.when(F.col("model_no") == 1, louder).otherwise(F.col("item")))


@query
def merge_summaries(spark, d):
    return models.merge_summaries(_model_items(spark, d)).select(
        "analysis_id", "section", _joined("items").alias("items")
    )


@query
def merge_answers(spark, d):
    answers = read_table(spark, d, "conversations").select(
        F.col("conv_id").alias("analysis_id"), F.col("turn").alias("model_no"),
        F.col("text").alias("answer"),
    )
    return models.merge_answers(answers)


@query
def parse_model_json(spark, d):
    body = F.to_json(F.struct(
        F.col("observations").alias("Compliance observations"),
        F.col("security_risks").alias("Security risks"),
        F.col("remediation").alias("Suggested remediation steps")))
    replies = _summarized(spark, d).select(
        "doc_id",
        F.when(F.col("doc_id") % 3 == 0, body)
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Sure:\n"), body, F.lit("\nbye")))
        .otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```"))).alias("reply"),
    )
    return models.parse_model_json(replies).select("doc_id", F.inline("sections")).select(
        "doc_id", "section", _joined("items").alias("items")
    )


@query
def fallback_choice(spark, d):
    chosen = models.choose_output(
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Model says "), F.col("risk_level"))),
        F.element_at("risk_reasons", 1), F.col("doc_id") % 5 != 0,
        F.when(F.col("doc_id") % 2 == 0, F.lit("timeout")),
    )
    return _assessed(spark, d).select("doc_id", chosen.alias("c")).select("doc_id", "c.*")


# --- batches ----------------------------------------------------------------


@query
def batch_meta(spark, d):
    return batches.batch_totals(_measured(spark, d))


@query
def batch_files(spark, d):
    return batches.batch_files(_measured(spark, d)).select("batch_id", "doc_id", "listing")


@query
def combined_text(spark, d):
    ranges = batches.source_ranges(_measured(spark, d))
    return batches.combine_text(_docs(spark, d), ranges).select(
        "batch_id", "doc_id", "section_start", F.length("section").alias("length"),
        F.md5("section").alias("digest"),
    )


@query
def source_ranges(spark, d):
    return batches.source_ranges(_measured(spark, d)).select(
        "batch_id", "doc_id", "start", "end"
    )


@query
def map_to_source(spark, d):
    """Findings placed in the combined text and attributed back to files."""
    ranges = batches.source_ranges(_measured(spark, d))
    spans = _facts(spark, d).select("doc_id", "batch_id", "category", "start", "end").join(
        ranges.select("doc_id", F.col("start").alias("_at")), "doc_id"
    ).select(
        "batch_id", "category", (F.col("_at") + F.col("start")).alias("start"),
        (F.col("_at") + F.col("end")).alias("end"),
    )
    return batches.map_to_source(spans, ranges)


@query
def batch_dashboard(spark, d):
    docs = risk.with_counts(_scans(spark, d)).select(
        "batch_id", "doc_id", "file_name", "file_type", F.col("n_chars").alias("characters"),
        "n_findings",
    )
    return batches.batch_dashboard(docs)


@query
def analysis_fingerprints(spark, d):
    docs = _docs(spark, d).withColumn("user_id", F.col("batch_id"))
    return batches.analysis_fingerprint(docs).select("batch_id", "fingerprint")


@query
def upload_fingerprints(spark, d):
    files = _docs(spark, d).withColumn("user_id", F.col("batch_id")).withColumn(
        "content", F.col("text").cast("binary")
    )
    return batches.upload_fingerprint(files).select("batch_id", "fingerprint")


@query
def persist_once(spark, d):
    """Analyses of documents whose id no reviewer label has stored yet."""
    analyses = _docs(spark, d).select(
        F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("analysis_id"), "lang"
    )
    twice = analyses.unionByName(analyses)
    stored = read_table(spark, d, "labels").select(
        F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("analysis_id")
    )
    return batches.persist_once(twice, stored)


# --- ingest -----------------------------------------------------------------


def _customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers dealt over all cores: a task per file or row group would flatten far more than it reads."""
    rows = read_table(spark, d, "customer")
    return rows.repartition(max(rows.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism))


def _flattened(files: DataFrame) -> DataFrame:
    """Add the delimiter ``d`` and the flattened text ``f`` of each CSV text ``t``, each found once."""
    return computed_once(computed_once(files, {"d": infer_delimiter(F.col("t"))}),
                         {"f": flatten_csv(F.col("t"), F.col("d"))})


@query
def csv_flatten(spark, d):
    """Every customer, with all its columns, as a small ragged CSV text."""
    cells = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    full = F.concat_ws(";", *[F.col(c).cast("string") for c in cells])
    text = F.concat(
        F.lit("id;name;;balance;segment\n"), full, F.lit("\n\n"), full, F.lit(";extra\n"),
    )
    rows = _flattened(_customers(spark, d).select("c_custkey", text.alias("t")))
    return rows.select("c_custkey", F.col("f.text").alias("text"), "f.rows", "f.columns")


@query
def csv_delimiters(spark, d):
    """Customers as CSV texts with each delimiter in turn, one of them quoted."""
    marks = [",", "\t", "|", ";"]
    mark = F.array(*[F.lit(m) for m in marks])[(F.col("c_custkey") % 4).cast("int")]
    quoted = F.concat(F.lit('"a'), mark, F.lit(' ""b"""'))
    text = F.concat(F.concat_ws("\n", F.concat(F.lit("id"), mark, F.lit("name"), mark, F.lit("note")),
                                F.concat(F.col("c_custkey").cast("string"), mark, F.col("c_name"), mark, quoted)))
    rows = _flattened(_customers(spark, d).select("c_custkey", text.alias("t")))
    return rows.select("c_custkey", F.col("d").alias("delimiter"), F.col("f.text").alias("text"))


@query
def page_assembly(spark, d):
    """Pages in threes as documents."""
    pages = read_table(spark, d, "pages").select(
        F.floor(F.col("page_id") / 3).alias("doc_id"), (F.col("page_id") % 3 + 1).alias("page_no"),
        F.col("html").alias("text"),
    )
    return page_source.assemble_pages(pages).select(
        "doc_id", F.md5("text").alias("digest"), "pages", "characters", "extraction_method", "ocr_status",
    )


@query
def page_fallback(spark, d):
    """URLs as embedded text: pages with short ones fall back to their html."""
    pages = read_table(spark, d, "pages")
    one = lambda c: pages.select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page_no"), F.col(c).alias("text"))
    return page_source.assemble_pages(one("url"), one("html")).select(
        "doc_id", F.md5("text").alias("digest"), "pages", "characters", "extraction_method", "ocr_status",
    )


@query
def export_text(spark, d):
    plan = compliance.action_plan(_assessed(spark, d))
    return sinks.rows_as_text(plan.drop("doc_id")).groupBy("value").agg(F.count("*").alias("n"))


@query
def export_json(spark, d):
    """Findings as JSON objects in files named after their document's category and source."""
    rows = _facts(spark, d).select("doc_id", "source", "category", "start", "end", "severity", "confidence")
    named = sinks.named_exports(rows, F.concat("source", F.lit(": "), "category"), "json")
    return sinks.rows_as_json(named, "doc_id", "source", "export_name").select("doc_id", "export_name", "json")


@query
def export_html(spark, d):
    page = sinks.html_page(_facts(spark, d), "Findings & reasons", "value")
    return page.select("doc_id", "start", F.md5("html").alias("digest"))


@query
def redacted_export(spark, d):
    """Redacted texts written to a table and read back."""
    folder = f"{scratch_dir(spark)}/redacted"
    sinks.write_redacted(_scans(spark, d), folder)
    return spark.read.parquet(folder).select(
        "doc_id", "file_name", F.md5("redacted_text").alias("digest")
    )


@query
def text_files(spark, d):
    """Documents as files in UTF-8, UTF-8 with a mark, or Latin-1 where they fit it."""
    raw = F.encode("text", "UTF-8")
    fits = F.col("text").rlike(r"^[\x00-\x7f\xa0-\xff]*$")
    files = read_table(spark, d, "documents").select(
        F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("EFBBBF")), raw))
        .when((F.col("doc_id") % 3 == 2) & fits,
              F.encode(F.when(fits, F.col("text")).otherwise(""), "ISO-8859-1"))
        .otherwise(raw).alias("content"),
    )
    return file_source.load_text_files(file_source.with_file_type(files)).select(
        "path", "file_name", "file_type", F.md5("text").alias("digest"), "characters"
    )


@query
def rejected_files(spark, d):
    """Pages as files of a type no loader takes."""
    files = read_table(spark, d, "pages").select(
        F.concat(F.lit("/in/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.encode("html", "UTF-8").alias("content"),
    )
    return file_source.rejected_files(file_source.with_file_type(files))


@query
def semantic_signals(spark, d):
    """Labels and scores of a scorer, here taken from the columns of each document."""
    scored = _docs(spark, d).select(
        "doc_id", F.array("lang", "source", "file_name").alias("labels"),
        F.array(F.length("text").cast("string"), F.lit("n/a"), F.lit("0.5")).alias("scores"),
    )
    return nlp.semantic_signals(scored).select(
        "doc_id", _joined("semantic_labels").alias("labels"),
        F.aggregate("signals", F.lit(0.0), lambda a, x: a + x["score"]).alias("total"), "nlp_status",
    )


# --- streams ----------------------------------------------------------------


def _stream(spark: SparkSession, d: str, table: str) -> DataFrame:
    """The files of a table, which is one file or a folder of files: only a glob path takes both.

    Below a glob path Spark finds the columns that name a table's subfolders only with a base path."""
    schema = read_table(spark, d, table).schema
    return spark.readStream.schema(schema).option("basePath", d).parquet(f"{d}/[{table[0]}]{table[1:]}.parquet")


def _run_to_table(rows: DataFrame, folder: str) -> DataFrame:
    done = (
        rows.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows")
        .trigger(availableNow=True).start()
    )
    done.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/rows")


@query
def stream_scan(spark, d):
    """The scan plan on a document stream, written to and read back from a table."""
    docs = _stream(spark, d, "documents").select("doc_id", "lang", "text")
    folder = scratch_dir(spark)
    jobs.write_batches(
        docs, f"{folder}/state", available_now=True, scans=(f"{folder}/rows", lambda batch: jobs.stream_scan(batch).select(
            "doc_id", "lang", "risk_level", "risk_score", "n_findings",
            F.md5("redacted_text").alias("redacted_digest"))),
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/rows").drop("batch_id")


@query
def stream_files(spark, d):
    """Benchmark items as text files, customers as one CSV file per nation and regions as JSON, from a
    stream of files: texts and tables become documents, the rest is rejected."""
    folder = scratch_dir(spark)
    items = read_table(spark, d, "benchmark").select("item_id", "text")
    items.repartition("item_id").write.partitionBy("item_id").text(f"{folder}/in/txt")
    people = read_table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("nation"))
    people.repartition("nation").sortWithinPartitions("nation", "c_custkey").write.partitionBy("nation").option(
        "header", "true").csv(f"{folder}/in/csv")
    read_table(spark, d, "region").repartition("r_regionkey").write.partitionBy("r_regionkey").json(f"{folder}/in/json")
    jobs.stream_documents(
        jobs.file_stream(spark, f"{folder}/in/*/*", max_files=200), f"{folder}/documents", f"{folder}/rejects",
        f"{folder}/state", available_now=True).awaitTermination()
    origin = F.regexp_extract("path", r"/in/[a-z]+/([a-z_]+=[0-9]+)/", 1).alias("origin")
    loaded = spark.read.parquet(f"{folder}/documents").select(
        origin, "file_type", F.md5("text").alias("digest"), "rows", "columns", F.lit(None).cast("string").alias("reason"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rejected = spark.read.parquet(f"{folder}/rejects").select(
        origin, none("string", "file_type"), none("string", "digest"), none("int", "rows"), none("int", "columns"), "reason")
    return loaded.unionByName(rejected)


@query
def stream_persist(spark, d):
    """Analyses of conversations from a stream of their turns, appended once each."""
    analyses = _stream(spark, d, "conversations").select(
        F.concat(F.lit("a"), F.col("conv_id").cast("string")).alias("analysis_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 60).alias("created_at"),
    )
    folder = scratch_dir(spark)
    jobs.stream_persist(
        analyses, f"{folder}/rows", f"{folder}/state", "30 days", available_now=True
    ).awaitTermination()
    return keyed.read_keyed(spark, f"{folder}/rows").select("analysis_id")


@query
def stream_monitor(spark, d):
    """Windowed monitor on the event stream: windows come once the watermark has passed them."""
    rows = jobs.monitor(_trace_rows(_stream(spark, d, "events")), "1 day").select(
        _stamp("window_start").alias("window_start"), "calls", "fallbacks", "max_latency_ms",
        "fallback_rate",
    )
    return _run_to_table(rows, scratch_dir(spark))


@query
def monitor_windows(spark, d):
    """The same monitor as a batch aggregate, by hour."""
    return jobs.monitor(_traces(spark, d), "1 hour").select(
        _stamp("window_start").alias("window_start"), "calls", "fallbacks", "max_latency_ms",
        "fallback_rate",
    )


def _called(docs: DataFrame) -> DataFrame:
    """Documents with the time of their scan and the status of their model call."""
    return docs.withColumns({
        "created_at": _doc_time(),
        "status": F.when(F.col("doc_id") % 5 == 0, "Rules fallback (timeout)").otherwise("Enhanced analysis"),
        "model_provider": F.when(F.col("doc_id") % 7 == 0, "local").otherwise("groq"),
    })


@query
def scan_monitor(spark, d):
    """Documents, findings, high-risk documents and fallback share per hour of scan time."""
    return jobs.scan_monitor(_called(_assessed(spark, d))).select(
        _stamp("window_start").alias("window_start"), "documents", "findings", "high_risk", "fallbacks", "fallback_rate",
    )


@query
def stream_scan_monitor(spark, d):
    """The same from a stream of documents, scanned as they come, for windows that have closed."""
    docs = _stream(spark, d, "documents").select("doc_id", "text").repartition(
        spark.sparkContext.defaultParallelism)
    rows = jobs.scan_monitor(_called(risk.assess(detect.scan(docs)))).select(
        _stamp("window_start").alias("window_start"), "documents", "findings", "high_risk", "fallbacks", "fallback_rate",
    )
    return _run_to_table(rows, scratch_dir(spark))
