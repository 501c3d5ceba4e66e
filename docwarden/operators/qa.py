"""Keyword-routed answers about scanned documents."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwarden.catalog import (
    ANSWER_AUDIT_TAIL, ANSWER_EMPTY, ANSWER_HELP, ANSWER_INJECTION, ANSWER_NO_INJECTION,
    ANSWER_NONE, ANSWER_REDACT, CATEGORY_ALIASES, LOCAL_QUESTION_SIGNALS,
)
from docwarden.functions.masking import mask_value
from docwarden.functions.sqltext import quote
from docwarden.functions.text import strip
from docwarden.operators.risk import category_map_text


def _has(*words: str) -> str:
    return "(" + " OR ".join(f"contains(_q, {quote(w)})" for w in words) + ")"


def _matched_sql() -> str:
    tests = ", ".join(
        f"IF(contains(_q, {quote(alias)}) AND array_contains(categories, {quote(cat)}), "
        f"{quote(cat)}, NULL)"
        for alias, cat in CATEGORY_ALIASES
    )
    return f"coalesce({tests})"


_N = "filter(ranked, r -> r.category = _m)[0].n"
_INJECTIONS = (
    "coalesce(try_element_at(filter(ranked, r -> r.category = 'Prompt Injection Attempt'), 1).n, 0)"
)


def _answer_sql() -> str:
    """Ordered router: the first rule whose words occur decides."""
    total = "concat(n_findings, ' sensitive item(s) were found in total.')"
    counted = f"concat({_N}, ' ', lower(_m), ' item(s) were found.')"
    audit = (
        "concat('Audit note: Document classified as ', risk_level, ' with score ', risk_score, "
        "'/100. ', n_findings, ' sensitive item(s) detected across ', size(categories), "
        "' category/categories: ', "
        f"IF(n_findings = 0, 'none', {category_map_text(limit=5)}), '. ', "
        f"{quote(ANSWER_AUDIT_TAIL)})"
    )
    steps = (
        "array_join(transform(slice(remediation, 1, 4), (s, i) -> concat(i + 1, '. ', s)), ' ')"
    )
    examples = (
        "array_join(transform(slice(filter(masked, x -> x.category = _m), 1, 5), x -> x.masked), "
        "', ')"
    )
    return f"""CASE
      WHEN _q = '' THEN {quote(ANSWER_EMPTY)}
      WHEN {_has('how many', 'count')} THEN IF(_m IS NULL, {total}, {counted})
      WHEN {_has('what sensitive', 'sensitive data', 'exists')} THEN
        IF(n_findings = 0, {quote(ANSWER_NONE)},
           concat('Detected categories: ', {category_map_text()}))
      WHEN {_has('compliance', 'risk')} THEN array_join(concat(observations, security_risks), ' ')
      WHEN {_has('summarize', 'summary')} THEN extract_summary
      WHEN {_has('remediate', 'remediation', 'first')} THEN
        concat('Recommended priority order: ', {steps})
      WHEN {_has('audit')} THEN {audit}
      WHEN {_has('redact', 'mask')} THEN {quote(ANSWER_REDACT)}
      WHEN {_has('prompt injection', 'jailbreak', 'guardrail')} THEN
        IF({_INJECTIONS} > 0, concat({_INJECTIONS}, {quote(ANSWER_INJECTION)}),
           {quote(ANSWER_NO_INJECTION)})
      WHEN _m IS NOT NULL THEN
        concat({_N}, ' ', lower(_m), ' item(s) were found. Examples: ', {examples}, '.')
      ELSE {quote(ANSWER_HELP)} END"""


def _local_sql() -> str:
    return _has(*LOCAL_QUESTION_SIGNALS)


def answer_basis(summarized: DataFrame) -> DataFrame:
    """The columns answers are made of; the document text is left behind."""
    masked = F.transform(
        "findings",
        lambda f: F.struct(f["category"].alias("category"), mask_value(f["value"]).alias("masked")),
    )
    return summarized.select(
        "doc_id", "n_findings", "n_high", "categories", "ranked", "risk_level", "risk_score",
        "observations", "security_risks", "remediation", "extract_summary",
        masked.alias("masked"),
    )


def _route(rows: DataFrame) -> DataFrame:
    routed = rows.withColumn("_q", F.lower(strip(F.col("question")))).selectExpr(
        "*", f"{_matched_sql()} AS _m"
    )
    return routed.selectExpr(
        "doc_id", "question_id", "question", "_m AS matched_category",
        f"{_local_sql()} AS is_local", f"{_answer_sql()} AS answer",
    )


def answer_all(summarized: DataFrame, questions: Iterable[str]) -> DataFrame:
    """Every question for every document; fixed questions ride along in the row."""
    listed = F.array(*[
        F.struct(F.lit(i).alias("question_id"), F.lit(q).alias("question"))
        for i, q in enumerate(questions)
    ])
    return _route(answer_basis(summarized).select("*", F.inline(listed)))


def answer_questions(questions: DataFrame, summarized: DataFrame) -> DataFrame:
    """Answer ``(question_id, doc_id, question)`` rows; adaptive execution splits hot documents."""
    joined = answer_basis(summarized).join(questions, "doc_id")
    return _route(joined)


def latest_turns(history: DataFrame, keep: int = 6) -> DataFrame:
    """The latest ``keep`` turns of every session, newest first (turn 1)."""
    from pyspark.sql import Window

    newest = Window.partitionBy("session_id").orderBy(F.col("turn").desc())
    return history.withColumn("position", F.row_number().over(newest)).where(
        F.col("position") <= keep
    )
