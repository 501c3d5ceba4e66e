"""Risk scoring per document and per wider scope (batch, source, language)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.catalog import DETECTORS, NO_FINDINGS_REASON, RISK_REASON_RULES
from docwarden.functions.sqltext import any_of, present, quote, string_array

HIGH_CATEGORIES = tuple(dict.fromkeys(d.category for d in DETECTORS if d.severity == "High"))

# What every report needs about one document, derived from its findings only.
_COUNTS = {
    "n_findings": "size(findings)",
    "n_high": "size(filter(findings, f -> f.severity = 'High'))",
    # distinct categories by first appearance
    "categories": "array_distinct(transform(findings, f -> f.category))",
}
_RANKED = """
transform(
  sort_array(transform(categories, (c, i) -> named_struct(
    'k', -size(filter(findings, f -> f.category = c)), 'i', i, 'c', c))),
  x -> named_struct('category', x.c, 'n', -x.k))
"""


def with_counts(scans: DataFrame) -> DataFrame:
    """Add n_findings, n_high, categories and ranked (most common first)."""
    return scans.selectExpr(
        "*", "length(text) AS n_chars", *[f"{sql} AS {name}" for name, sql in _COUNTS.items()]
    ).selectExpr("*", f"{_RANKED} AS ranked")


def _score_sql() -> str:
    injected = "array_contains(categories, 'Prompt Injection Attempt')"
    base = "n_high * 18 + (n_findings - n_high) * 8 + size(categories) * 5"
    sized = f"least(100, {base}) + IF(n_chars > 20000 AND n_findings > 20, 10, 0)"
    full = f"least(100, least(100, {sized}) + IF({injected}, 25, 0))"
    return f"cast(IF(n_findings = 0, 5, {full}) AS int)"


_LEVEL_SQL = """
CASE WHEN n_findings = 0 THEN 'Low Risk'
     WHEN array_contains(categories, 'Prompt Injection Attempt') THEN 'High Risk'
     WHEN risk_score >= 65 OR n_high >= 3 THEN 'High Risk'
     WHEN risk_score >= 25 OR n_high >= 1 OR n_findings >= 4 THEN 'Medium Risk'
     ELSE 'Low Risk' END
"""


def _reasons_sql() -> str:
    lines = [
        "concat('AI/ML ensemble found ', n_findings, ' sensitive item(s) across ', "
        "size(categories), ' category/categories.')",
        "concat(n_high, ' high-severity item(s) and ', n_findings - n_high, "
        "' medium-severity item(s) detected.')",
    ] + [f"IF({any_of('categories', cats)}, {quote(text)}, NULL)"
         for cats, text in RISK_REASON_RULES]
    return f"IF(n_findings = 0, array({quote(NO_FINDINGS_REASON)}), {present(lines)})"


def with_risk(counted: DataFrame) -> DataFrame:
    """Add risk_score, risk_level and risk_reasons to counted rows."""
    return (
        counted.selectExpr("*", f"{_score_sql()} AS risk_score")
        .selectExpr("*", f"{_LEVEL_SQL} AS risk_level", f"{_reasons_sql()} AS risk_reasons")
    )


def assess(scans: DataFrame) -> DataFrame:
    return with_risk(with_counts(scans))


def section_header() -> Column:
    """Header line a document gets inside a multi-document scan."""
    return F.concat(
        F.lit("\n\n===== Document: "), F.col("file_name"), F.lit(" ("), F.col("file_type"),
        F.lit(") =====\n"),
    )


def assess_groups(scans: DataFrame, *keys: str) -> DataFrame:
    """Risk of the union of findings of all documents sharing ``keys``.

    Each document is first reduced to one row per category (at most as many as
    there are detectors). The first aggregation combines map-side, so a group
    holding most of the data costs no more than a small one; the second sees at
    most one row per category and group.
    """
    # Lengths are taken before rows multiply, so that no text is carried into the rows per category.
    listed = scans.select(
        *keys, "doc_id",
        F.length("text").alias("chars"), F.length(section_header()).alias("header"),
        F.expr(
            """transform(array_distinct(transform(findings, f -> f.category)),
                 c -> named_struct('category', c,
                   'n', size(filter(findings, f -> f.category = c)),
                   'first', array_min(transform(filter(findings, f -> f.category = c),
                                                f -> f.start))))"""
        ).alias("_listed"),
    )
    per_category = listed.select(
        *keys, "doc_id", "chars", "header", F.posexplode_outer("_listed").alias("i", "c"))
    once = F.coalesce(F.col("i"), F.lit(0)) == 0
    by_category = per_category.groupBy(*keys, F.col("c.category").alias("category")).agg(
        F.sum("c.n").alias("n"),
        F.min(F.struct("doc_id", F.col("c.first").alias("start"))).alias("first"),
        F.sum(F.when(once, 1).otherwise(0)).alias("docs"),
        F.sum(F.when(once, F.col("chars")).otherwise(0)).alias("chars"),
        F.sum(F.when(once, F.col("header")).otherwise(0)).alias("headers"),
    )
    high = F.col("category").isin(*HIGH_CATEGORIES)
    grouped = by_category.groupBy(*keys).agg(
        F.sum("docs").alias("n_documents"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_findings"),
        F.sum(F.when(high, F.col("n")).otherwise(0)).alias("n_high"),
        F.sum("chars").alias("text_chars"),
        F.sum("headers").alias("headers"),
        F.collect_list(
            F.when(F.col("category").isNotNull(),
                   F.struct((-F.col("n")).alias("k"), "first", "category"))
        ).alias("found"),
    )
    ranked = grouped.selectExpr(
        *keys, "n_documents", "n_findings", "n_high",
        "text_chars + IF(n_documents > 1, headers, 0) AS n_chars",
        "transform(sort_array(found), x -> named_struct('category', x.category, "
        "'n', -x.k)) AS ranked",
        "transform(array_sort(found, (a, b) -> CASE WHEN a.first < b.first THEN -1 ELSE 1 END), "
        "x -> x.category) AS categories",
    )
    return with_risk(ranked)


def category_totals(facts: DataFrame, *keys: str) -> DataFrame:
    """Findings per category and the share of the largest category."""
    counts = facts.groupBy(*keys, "category").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "start")).alias("first")
    )
    # A group has at most one row per category left, so its list is short.
    listed = counts.groupBy(*keys).agg(
        F.collect_list(F.struct("category", "n", "first")).alias("_c")
    )
    top = F.array_max(F.transform("_c", lambda c: c["n"]))
    rows = listed.withColumn("_top", top).select(*keys, "_top", F.inline("_c"))
    return rows.select(
        *keys, "category", "n", "first", F.round(F.col("n") / F.col("_top"), 6).alias("ratio")
    )


def severity_totals(facts: DataFrame, *keys: str) -> DataFrame:
    return facts.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("severity") == "High").alias("high"),
        F.count_if(F.col("severity") == "Medium").alias("medium"),
    )


def corpus_metrics(assessed: DataFrame) -> DataFrame:
    """One metrics row per document."""
    return assessed.select(
        "doc_id", "file_name", "file_type", "risk_level", "risk_score", "n_findings", "n_high",
        F.coalesce(
            F.expr("try_element_at(ranked, 1).category"), F.lit("No sensitive category")
        ).alias("top_category"),
        "n_chars",
        F.size("categories").alias("n_categories"),
    )


def category_map_text(ranked: str = "ranked", limit: int | None = None) -> str:
    """SQL text: ``Category (n), Category (n)`` most common first."""
    source = ranked if limit is None else f"slice({ranked}, 1, {limit})"
    return f"array_join(transform({source}, r -> concat(r.category, ' (', r.n, ')')), ', ')"


def group_counts(assessed: DataFrame, groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """Add one finding count per category group."""
    return assessed.selectExpr(
        "*",
        *[f"size(filter(findings, f -> array_contains({string_array(cats)}, f.category))) AS {name}"
          for name, cats in groups.items()],
    )
