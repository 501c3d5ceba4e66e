"""Rule-based document summaries, all computed inside the document row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.catalog import (
    EMPTY_TEXT_NOTE, GENERAL_PROFILE, PROFILE_TERMS, REMEDIATION_ALWAYS, REMEDIATION_PDF,
    REMEDIATION_RULES, SECURITY_RISK_FALLBACK, SECURITY_RISK_RULES, SUMMARY_SECTIONS,
)
from docwarden.functions.once import computed_once
from docwarden.functions.sqltext import any_of, present, quote
from docwarden.functions.text import compact, count_of
from docwarden.operators.risk import category_map_text

HEAD_CHARS = 4_096
LEAD_CHARS = 600


def _profile(lowered: Column) -> Column:
    scored = [
        F.struct(
            reduce(Column.__add__, [count_of(lowered, t) for t in terms]).alias("score"),
            F.lit(-i).alias("rank"), F.lit(label).alias("label"),
        )
        for i, (label, terms) in enumerate(PROFILE_TERMS)
    ]
    best = F.array_max(F.array(*scored))
    return F.struct(best["score"].alias("score"), best["label"].alias("label"))


def document_profile(docs: DataFrame) -> DataFrame:
    """Add ``profile``: the label whose terms occur most, ties to the first."""
    best = computed_once(
        docs.withColumn("_low", F.lower("text")), {"_best": _profile(F.col("_low"))}
    )
    return best.withColumn(
        "profile",
        F.when(F.col("_best.score") > 0, F.col("_best.label")).otherwise(GENERAL_PROFILE),
    ).drop("_low", "_best")


def _first_sentence(flat: Column, end: str) -> Column:
    return F.regexp_extract(flat, rf"(.{{40,220}}?[.!?])(?:{end})", 1)


def _lead_sentences(flat: Column) -> Column:
    """The first three sentences, at most 600 characters.

    Compacted text has single spaces, so joining the sentences again is the same
    as taking a prefix: two characters past the cap decide where it ends.
    """
    start = F.left(flat, F.lit(LEAD_CHARS + 2))
    parts = F.slice(F.split(start, "(?<=[.!?]) +", -1), 1, 3)
    return F.left(F.array_join(parts, " "), F.lit(LEAD_CHARS))


def document_excerpt(docs: DataFrame) -> DataFrame:
    """Add ``excerpt`` (first sentence-like stretch) and ``lead_sentences``.

    Both are nearly always settled by the head of the text, which is tried
    first. Where it does not settle them the whole text is used, so the result
    is always that of the whole text: a sentence found in the head and followed
    by a space is the first one, because any earlier start that runs past the
    head would also reach the end of that sentence.
    """
    headed = computed_once(docs, {"_head": compact(F.left("text", F.lit(HEAD_CHARS)))})
    whole_in_head = F.length("text") <= HEAD_CHARS
    tried = computed_once(headed, {"_found": _first_sentence(F.col("_head"), " ")})
    flat = compact(F.col("text"))
    late = F.coalesce(
        F.nullif(_first_sentence(flat, r" |\z"), F.lit("")), F.left(flat, F.lit(180))
    )
    head_is_enough = whole_in_head | (F.length("_head") >= LEAD_CHARS + 2)
    return computed_once(
        tried,
        {
            "excerpt": F.left(
                F.when(F.col("_found") != "", F.col("_found")).otherwise(late), F.lit(220)
            ),
            "lead_sentences": F.when(head_is_enough, _lead_sentences(F.col("_head"))).otherwise(
                _lead_sentences(flat)
            ),
        },
    ).drop("_head", "_found")


def _observations_sql() -> str:
    high = "array_sort(array_distinct(transform(filter(findings, f -> f.severity = 'High'), f -> f.category)))"
    return present([
        "concat('Document risk is classified as ', risk_level, ' with a score of ', risk_score, "
        "'/100.')",
        "concat('AI/ML detection found ', n_findings, ' sensitive item(s) in ', size(categories), "
        "' category/categories.')",
        "concat('Document context appears to be ', profile, '.')",
        f"IF(n_findings > 0, concat('Most prominent sensitive data types: ', "
        f"{category_map_text(limit=6)}, '.'), NULL)",
        f"IF(n_high > 0, concat('High-priority categories requiring review: ', "
        f"array_join({high}, ', '), '.'), NULL)",
        "IF(n_findings > 0 AND excerpt <> '', concat('Context cue from document: ', excerpt, '.'), "
        "NULL)",
        "IF(n_findings = 0, 'No configured sensitive-data indicators were identified.', NULL)",
    ])


def _security_risks_sql() -> str:
    def rule(cats: tuple[str, ...], words: tuple[str, ...], text: str) -> str:
        tests = [any_of("categories", cats)] if cats else []
        tests += [f"contains(profile, {quote(w)})" for w in words]
        return f"IF({' OR '.join(tests)}, {quote(text)}, NULL)"

    lines = present([rule(*r) for r in SECURITY_RISK_RULES])
    return f"transform(array({lines}), l -> IF(size(l) = 0, array({quote(SECURITY_RISK_FALLBACK)}), l))[0]"


def _remediation_sql() -> str:
    return present(
        [f"IF({any_of('categories', cats)}, {quote(t)}, NULL)" for cats, t in REMEDIATION_RULES]
        + [quote(t) for t in REMEDIATION_ALWAYS]
        + [f"IF(contains(lower(left(text, 200)), 'pdf'), {quote(REMEDIATION_PDF)}, NULL)"]
    )


def summarize(assessed: DataFrame) -> DataFrame:
    """Add profile, excerpt, observations, security_risks, remediation, extract_summary."""
    described = document_excerpt(document_profile(assessed))
    lead = f"coalesce(nullif(lead_sentences, ''), {quote(EMPTY_TEXT_NOTE)})"
    return described.selectExpr(
        "*",
        f"{_observations_sql()} AS observations",
        f"{_security_risks_sql()} AS security_risks",
        f"{_remediation_sql()} AS remediation",
        f"concat({lead}, ' Risk classification: ', risk_level, '. Sensitive items detected: ', "
        "n_findings, '.') AS extract_summary",
    )


def summary_text(status: str) -> str:
    """SQL text: the three sections as bullets below a ``Generated with`` line."""
    columns = ("observations", "security_risks", "remediation")
    sections = [
        f"concat({quote(name)}, '\\n', array_join(transform({col}, i -> concat('- ', i)), '\\n'))"
        for name, col in zip(SUMMARY_SECTIONS, columns)
    ]
    return f"concat('Generated with: ', {status}, '\\n\\n', concat_ws('\\n\\n', {', '.join(sections)}))"
