"""Evaluation, model monitoring and governance metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.catalog import CONTEXTUAL_ALL, LOCAL_MODEL, LOCAL_PROVIDER, PROMPT_VERSION
from docwarden.functions.sqltext import quote, string_array
from docwarden.functions.text import whole_percent

COVERAGE_BASE = 25
EMPTY_TRACES = (
    "No AI traces yet", "Ask a question or generate a summary to populate monitoring.",
)


def feedback_metrics(feedback: DataFrame, *keys: str) -> DataFrame:
    """Verdict counts, precision over reviewed findings and review coverage."""
    counts = feedback.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.count_if(F.col("verdict") == "Correct").alias("correct"),
        F.count_if(F.col("verdict") == "False positive").alias("false_positives"),
        F.count_if(F.col("verdict") == "Missed sensitive data").alias("missed"),
    )
    reviewed = F.col("correct") + F.col("false_positives")
    return counts.select(
        *keys, "correct", "false_positives", "missed",
        F.when(reviewed > 0, F.col("correct") / reviewed).otherwise(0.0).alias("precision"),
        (F.col("_n") / F.greatest(F.lit(1), F.col("_n") + COVERAGE_BASE)).alias("coverage"),
    )


def trace_rows(calls: DataFrame) -> DataFrame:
    """Trace facts from raw call records.

    ``calls``: id, user_id, analysis_id, feature, provider, model, has_key,
    status, latency_ms, output, created_at. Without a key the call ran locally.
    """
    keyed = F.col("has_key")
    return calls.select(
        "id", "user_id", "analysis_id", "feature",
        F.when(keyed, F.col("provider")).otherwise(LOCAL_PROVIDER).alias("model_provider"),
        F.when(keyed, F.col("model")).otherwise(LOCAL_MODEL).alias("model_name"),
        F.lit(PROMPT_VERSION).alias("prompt_version"), "status", "latency_ms",
        F.left(F.sha2("output", 256), F.lit(16)).alias("output_hash"), "created_at",
    )


def config_signature(parts: list[Column]) -> Column:
    """Short digest of the model settings that make a cached summary reusable."""
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(16))


def is_fallback() -> Column:
    return F.contains(F.lower("status"), F.lit("fallback")) | (
        F.col("model_provider") == LOCAL_PROVIDER
    )


def trace_monitoring(traces: DataFrame) -> DataFrame:
    """Metric/value rows over all traces, or one placeholder row."""
    agg = traces.agg(
        F.count("*").alias("n"), F.sum(F.col("latency_ms").cast("bigint")).alias("total"),
        F.max("latency_ms").alias("top"), F.count_if(is_fallback()).alias("fallback"),
    ).withColumn("rate", whole_percent(F.col("fallback") / F.greatest(F.col("n"), F.lit(1))))
    rows = f"""CASE WHEN n = 0 THEN array(
        named_struct('row_no', 1, 'metric', {quote(EMPTY_TRACES[0])}, 'value', {quote(EMPTY_TRACES[1])}))
      ELSE array(
        named_struct('row_no', 1, 'metric', 'Total AI calls', 'value', cast(n AS string)),
        named_struct('row_no', 2, 'metric', 'Average latency',
                     'value', concat(total div greatest(1, n), ' ms')),
        named_struct('row_no', 3, 'metric', 'Max latency', 'value', concat(top, ' ms')),
        named_struct('row_no', 4, 'metric', 'Fallback/local rate', 'value', rate),
        named_struct('row_no', 5, 'metric', 'Prompt version', 'value', {quote(PROMPT_VERSION)})) END"""
    return agg.select(F.inline(F.expr(rows)))


def is_contextual_sql(finding: str) -> str:
    """SQL text: the finding comes from a contextual or model detector."""
    return (
        f"(contains({finding}.reason, 'AI/ML contextual') OR contains({finding}.reason, 'spaCy NER') "
        f"OR array_contains({string_array(CONTEXTUAL_ALL)}, {finding}.category))"
    )


def governance_metrics(assessed: DataFrame) -> DataFrame:
    """Injection, contextual and validator counts and truncated mean confidence.

    Confidence is summed in span order, so the double result never depends on
    how the data is split.
    """
    contextual = f"size(filter(findings, f -> {is_contextual_sql('f')}))"
    injected = "size(filter(findings, f -> f.category = 'Prompt Injection Attempt'))"
    total = "aggregate(findings, 0D, (a, f) -> a + f.confidence)"
    return assessed.selectExpr(
        "doc_id",
        f"{injected} AS guardrail_count",
        f"{contextual} AS contextual_count",
        f"n_findings - {contextual} AS validator_count",
        f"cast(({total} / greatest(1, n_findings)) * 100 AS int) AS avg_confidence",
    )


def stage_trace(
    assessed: DataFrame, ai_status: str = "Standard analysis", models_enabled: bool = False
) -> DataFrame:
    """Six rows per document that say what each processing stage saw."""
    injected = "size(filter(findings, f -> f.category = 'Prompt Injection Attempt'))"
    ocr = "ocr_status" if "ocr_status" in assessed.columns else "'not_applicable'"
    stages = [
        ("1. Document ingestion", "OCR/text extraction prepares machine-readable context.",
         f"concat(file_type, '; ', n_chars, ' chars; OCR=', {ocr})", "'Ready'"),
        ("2. Entity detection",
         "spaCy/contextual NER plus validator guardrails detect sensitive entities.",
         "concat(n_findings, ' finding(s), ', size(categories), ' categories.')", "'Ready'"),
        ("3. Risk model",
         "Weighted risk scoring combines severity, frequency, categories, and contextual entities.",
         "concat(risk_level, '; score ', risk_score, '/100.')", "'Ready'"),
        ("4. RAG retrieval",
         "Local hash-vector retrieval selects relevant redacted chunks for QA.",
         "'RAG enabled with local fallback; Chroma optional.'", "'Ready'"),
        ("5. LLM reasoning",
         "Private model ensemble generates summaries and open-ended answers when configured.",
         quote(ai_status), quote("Ready" if models_enabled else "Local fallback")),
        ("6. Guardrails", "Prompt-injection detector flags adversarial document instructions.",
         f"concat({injected}, ' guardrail signal(s).')",
         f"IF({injected} > 0, 'Review', 'Clear')"),
    ]
    rows = ", ".join(
        f"named_struct('stage', {quote(s)}, 'role', {quote(r)}, 'evidence', {e}, 'status', {st})"
        for s, r, e, st in stages
    )
    return assessed.select("doc_id", F.inline(F.expr(f"array({rows})")))


def feedback_view(feedback: DataFrame) -> DataFrame:
    return feedback.select(
        F.col("created_at").alias("Date"), F.col("category").alias("Category"),
        F.col("masked_value").alias("Masked value"), F.col("verdict").alias("Verdict"),
        F.col("note").alias("Note"),
    )


def trace_view(traces: DataFrame) -> DataFrame:
    return traces.select(
        F.col("created_at").alias("Date"), F.col("feature").alias("Feature"),
        F.col("model_provider").alias("Provider"), F.col("model_name").alias("Model"),
        F.col("prompt_version").alias("Prompt"), F.col("status").alias("Status"),
        F.col("latency_ms").alias("Latency ms"), F.col("output_hash").alias("Output hash"),
    )
