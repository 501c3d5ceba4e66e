"""Data work before and after external model calls (the calls are not made here).

Only redacted text and masked values enter what a model may see.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.catalog import ANSWER_MARKERS, CONTEXT_QUERY, SUMMARY_SECTIONS
from docwarden.functions.masking import mask_value, redacted
from docwarden.functions.once import computed_once
from docwarden.functions.text import first_chars, strip
from docwarden.operators.batches import first_per_group
from docwarden.operators.retrieval import retrieve
from docwarden.operators.scale import salted_lookup

CONTEXT_CHARS = 12_000
MAX_ITEMS = 5
NEW_TERMS = 3
EXTRA_DETAIL = "\n\nAdditional useful detail: "


def prepare_context(
    assessed: DataFrame, query: Column | str = CONTEXT_QUERY, chars: int | None = CONTEXT_CHARS
) -> DataFrame:
    """Add masked_findings, redacted_context (the first ``chars`` characters, None: all) and
    context (top 4 redacted chunks)."""
    masked = F.transform(
        "findings",
        lambda f: F.struct(
            f["category"].alias("category"), mask_value(f["value"]).alias("masked_value"),
            f["severity"].alias("severity"), F.round(f["confidence"], 2).alias("confidence"),
            f["reason"].alias("reason"),
        ),
    )
    safe = redacted(assessed).withColumn("masked_findings", masked).drop("text")
    ranked = retrieve(safe.withColumnRenamed("redacted_text", "text"), query)
    return ranked.withColumn("redacted_context", first_chars("text", chars)).drop("text")


def _sections_text() -> Column:
    numbered = F.transform(
        "context",
        lambda c, i: F.concat(F.lit("[Section "), (i + 1).cast("string"), F.lit("]\n"), c["text"]),
    )
    return F.when(F.size("context") > 0, F.array_join(numbered, "\n\n")).otherwise(
        "No retrieved sections available."
    )


def _evidence_text() -> list[Column]:
    counts = F.map_from_entries(
        F.transform("ranked", lambda r: F.struct(r["category"], r["n"]))
    )
    return [
        F.lit("\nDetected category counts: "), F.to_json(counts),
        F.lit("\nMasked findings: "), F.to_json("masked_findings"),
        F.lit("\n\nMost relevant document sections:\n"), _sections_text(),
        F.lit("\n\nRedacted document excerpt:\n"), F.col("redacted_context"),
    ]


def _risk_text() -> list[Column]:
    return [
        F.lit("Risk level: "), F.col("risk_level"),
        F.lit("\nRisk score: "), F.col("risk_score").cast("string"), F.lit("/100"),
    ]


SUMMARY_TASK = (
    "Answer with one JSON object that has exactly these array keys:\n"
    + "\n".join(f'- "{name}": three to five short strings' for name in SUMMARY_SECTIONS)
    + "\nTie every string to the findings below and name the most frequent and the most severe "
    "categories.\n\n"
)


def build_summary_prompt(prepared: DataFrame) -> DataFrame:
    reasons = [F.lit("\nRisk reasons: "), F.to_json("risk_reasons")]
    return prepared.withColumn(
        "prompt", strip(F.concat(F.lit(SUMMARY_TASK), *_risk_text(), *reasons, *_evidence_text()))
    )


def build_question_prompt(prepared: DataFrame) -> DataFrame:
    head = [F.lit("Question: "), F.col("question"), F.lit("\n\n")]
    return prepared.withColumn("prompt", strip(F.concat(*head, *_risk_text(), *_evidence_text())))


def parse_model_json(replies: DataFrame) -> DataFrame:
    """Read the three summary sections from free-form model replies.

    The outermost braces are taken; a string becomes a one-item list, blank
    items are dropped, other types give an empty list. Text that is not JSON
    gives null sections, so the caller falls back.
    """
    braces = F.regexp_extract("reply", r"(?s)(\{.*\})", 1)
    cleaned = F.coalesce(F.nullif(braces, F.lit("")), strip(F.col("reply")))
    parsed = computed_once(
        computed_once(replies, {"reply": F.col("reply"), "_c": cleaned}),
        {"_v": F.try_parse_json("_c")},
    )

    def section(name: str) -> Column:
        path = f"$['{name}']"
        kind = F.schema_of_variant(F.try_variant_get("_v", path, "variant"))
        items = F.filter(
            F.try_variant_get("_v", path, "array<string>"), lambda s: strip(s) != ""
        )
        return (
            F.when(F.col("_v").isNull(), F.lit(None))
            .when(kind == "STRING", F.array(F.try_variant_get("_v", path, "string")))
            .when(F.startswith(kind, F.lit("ARRAY")), F.coalesce(items, F.array()))
            .otherwise(F.array())
        )

    return parsed.select(
        *replies.columns,
        F.array(*[
            F.struct(F.lit(n).alias("section"), section(n).alias("items"))
            for n in SUMMARY_SECTIONS
        ]).alias("sections"),
    )


def normalized(text: Column) -> Column:
    """Case and punctuation removed, for spotting repeats."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "), F.lit(" "))


def merge_summaries(items: DataFrame, keep: int | None = MAX_ITEMS) -> DataFrame:
    """Merge model summaries: repeats dropped, model order kept, ``keep`` per section (None: all).

    ``items``: analysis_id, section, model_no, pos, item. Repeats are dropped by
    a map-side combined aggregate, so many copies of one item cost nothing.
    """
    distinct = items.withColumn("_norm", normalized(F.col("item"))).where("_norm <> ''").groupBy(
        "analysis_id", "section", "_norm"
    ).agg(
        F.min(F.struct("model_no", "pos", "item")).alias("f")
    )
    kept = distinct if keep is None else first_per_group(
        distinct, ["analysis_id", "section"], [F.col("f.model_no"), F.col("f.pos")], keep
    )
    return kept.groupBy("analysis_id", "section").agg(
        F.transform(F.array_sort(F.collect_list("f")), lambda f: f["item"]).alias("items")
    )


def _words(text: Column) -> Column:
    return F.array_distinct(
        F.regexp_extract_all(F.lower(text), F.lit("([a-zA-Z][a-zA-Z0-9_]{3,})"))
    )


def merge_answers(
    answers: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df
) -> DataFrame:
    """Best answer per analysis plus up to two sentences that add new terms.

    ``answers``: analysis_id, model_no, answer. Every step is an aggregate or a
    salted look-up: the best answer by (marker words, length, model order), then
    the first sentence with three terms it lacks, then the next one that still
    brings three terms beyond both. ``keep`` may store the two intermediate
    results that are used more than once (``docwarden.session.stored``).
    """
    unique = keep(
        answers.withColumn("_norm", normalized(F.col("answer"))).where("_norm <> ''")
        .groupBy("analysis_id", "_norm")
        .agg(F.min(F.struct("model_no", "answer")).alias("f"))
        .select("analysis_id", "f.model_no", "f.answer")
    )
    markers = sum(
        (F.contains(F.lower("answer"), F.lit(m)).cast("int") for m in ANSWER_MARKERS), F.lit(0)
    )
    strength = F.struct(
        markers.alias("m"), F.length("answer").alias("n"), (-F.col("model_no")).alias("o")
    )
    best = unique.groupBy("analysis_id").agg(
        F.max_by(F.struct("model_no", "answer"), strength).alias("b")
    ).select(
        "analysis_id", F.col("b.model_no").alias("_best_no"), F.col("b.answer").alias("best"),
        _words(F.col("b.answer")).alias("_base"),
    )
    sentences = unique.select(
        "analysis_id", "model_no",
        F.posexplode(F.split(strip(F.col("answer")), r"(?<=[.!?])[\s\x1c-\x1f\x85\p{Z}]+", -1))
        .alias("pos", "sentence"),
    ).withColumn("_terms", _words(F.col("sentence")))
    others = salted_lookup(
        sentences, best.select("analysis_id", "_best_no", "_base"), ["analysis_id"],
        F.struct("model_no", "pos"), "inner",
    ).where(F.col("model_no") != F.col("_best_no"))
    # Only sentences with enough terms beyond the best answer can ever be added.
    extra = keep(others.where(F.size(F.array_except("_terms", "_base")) >= NEW_TERMS))

    def first_new(rows: DataFrame, known: Column, name: str) -> DataFrame:
        fresh = rows.where(F.size(F.array_except("_terms", known)) >= NEW_TERMS)
        return fresh.groupBy("analysis_id").agg(
            F.min(F.struct("model_no", "pos", "sentence", "_terms")).alias(name)
        )

    one = first_new(extra, F.col("_base"), "_one")
    later = salted_lookup(
        extra, one, ["analysis_id"], F.struct("model_no", "pos"), "inner"
    ).where(F.struct("model_no", "pos") > F.struct("_one.model_no", "_one.pos"))
    two = first_new(later, F.concat(F.col("_base"), F.col("_one._terms")), "_two")
    joined = best.join(one, "analysis_id", "left").join(two, "analysis_id", "left")
    extras = F.concat_ws(" ", F.col("_one.sentence"), F.col("_two.sentence"))
    trimmed = F.regexp_replace("best", r"[\s\x1c-\x1f\x85\p{Z}]+\z", "")
    return joined.select(
        "analysis_id",
        F.when(F.col("_one").isNotNull(), F.concat(trimmed, F.lit(EXTRA_DETAIL), extras))
        .otherwise(F.col("best")).alias("answer"),
    )


def choose_output(model: Column, rules: Column, enabled: Column, error: Column) -> Column:
    """struct<output, status>: the model's output where it has one, else the rules'."""
    has = F.coalesce(model, F.lit("")) != ""
    reason = F.coalesce(error, F.lit("No configured model returned a response."))
    status = (
        F.when(~enabled, "Standard analysis")
        .when(has, "Enhanced analysis")
        .otherwise(F.concat(F.lit("Rules fallback ("), reason, F.lit(")")))
    )
    return F.struct(
        F.when(enabled & has, model).otherwise(rules).alias("output"), status.alias("status")
    )


def answer_status(
    is_local: Column, fast: Column, enabled: Column, model_status: Column
) -> Column:
    """Status of an answer: instant, standard, or what the model step reported."""
    return (
        F.when(fast & is_local, "Instant document analysis")
        .when(~enabled, "Standard analysis")
        .otherwise(model_status)
    )
