"""Control mappings, action plans, policy checks and the final report.

The rule tables are fixed and tiny, so they are literals inside the row: no
join is needed to meet every rule with every document.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarden.catalog import (
    ACTION_DEFAULT, ACTION_RULES, FRAMEWORKS, HEATMAP_GROUPS, PLAN_EXPORT, PLAN_QUARANTINE,
    PLAN_RECORD, PLAN_RULES, POLICY_CATALOGUE, POLICY_CONTROLS, REVIEW_FINAL_TASK, REVIEW_RULES,
    REVIEW_STATUSES, SEVERITY_DEFAULT, SEVERITY_SENTENCES,
)
from docwarden.functions.masking import mask_value
from docwarden.functions.sqltext import any_of, present, quote, string_array
from docwarden.functions.text import first_items, whole_percent
from docwarden.operators.risk import group_counts

EVIDENCE_ROWS = 80
REPORT_EVIDENCE = 30


def _matched(categories: Iterable[str]) -> str:
    return f"array_sort(array_intersect(categories, {string_array(categories)}))"


def _matched_text(matched: str, none: str) -> str:
    return f"IF(size({matched}) > 0, array_join({matched}, ', '), {quote(none)})"


def _priority(matched: str) -> str:
    return (
        f"CASE WHEN size({matched}) = 0 THEN 'Monitor' WHEN risk_level = 'High Risk' THEN 'High' "
        "ELSE 'Medium' END"
    )


def _frameworks_sql() -> str:
    rows = []
    for i, (name, cats, obligation, control) in enumerate(FRAMEWORKS):
        matched = _matched(cats)
        rows.append(
            f"named_struct('row_no', {i + 1}, 'framework', {quote(name)}, "
            f"'matched', {_matched_text(matched, 'No direct match')}, "
            f"'obligation', {quote(obligation)}, 'recommended_control', {quote(control)}, "
            f"'priority', {_priority(matched)})"
        )
    return f"array({', '.join(rows)})"


def framework_map(assessed: DataFrame) -> DataFrame:
    return assessed.select("doc_id", F.inline(F.expr(_frameworks_sql())))


def risk_heatmap(assessed: DataFrame) -> DataFrame:
    """Finding counts per document and category group with a risk signal.

    Documents without findings have no row, as in a heat map over findings.
    """
    counted = group_counts(assessed, {name: cats for name, cats in HEATMAP_GROUPS})
    signal = (
        F.when((F.col("credentials") > 0) | (F.col("financial") > 0), "Critical")
        .when((F.col("identity") > 0) | (F.col("confidential") > 0), "High")
        .otherwise("Monitor")
    )
    rows = counted.select(
        F.col("file_name").alias("document"), *[name for name, _ in HEATMAP_GROUPS],
        F.col("n_findings").alias("total"), signal.alias("risk_signal"),
    )
    return rows.where(F.col("total") > 0)


def heatmap_or_placeholder(heatmap: DataFrame) -> DataFrame:
    """The heat map, or one zero ``Current document`` row when it is empty.

    Whether it has a row is asked first, which stops at the first one found."""
    if not heatmap.isEmpty():
        return heatmap
    zeros = [f"CAST(0 AS INT) AS {name}" for name, _ in HEATMAP_GROUPS]
    return heatmap.sparkSession.range(1).selectExpr(
        "'Current document' AS document", *zeros, "CAST(0 AS INT) AS total", "'Monitor' AS risk_signal")


def _case(column: str, rules: Iterable[tuple[str, str]], default: str) -> str:
    tests = " ".join(f"WHEN {column} = {quote(k)} THEN {quote(v)}" for k, v in rules)
    return f"CASE {tests} ELSE {quote(default)} END"


def action_for(category: str) -> str:
    """SQL text: recommended action for a category expression."""
    pairs = [(c, action) for cats, action in ACTION_RULES for c in cats]
    return _case(category, pairs, ACTION_DEFAULT)


def recommended_actions(facts: DataFrame) -> DataFrame:
    return facts.withColumn("next_action", F.expr(action_for("category")))


def severity_explanations(scans: DataFrame, limit: int | None = EVIDENCE_ROWS) -> DataFrame:
    """The first ``limit`` findings of each document (None: all) with the reason for their severity."""
    rows = scans.select("doc_id", F.posexplode(first_items("findings", limit)).alias("i", "f"))
    return rows.select(
        "doc_id", (F.col("i") + 1).alias("row_no"), "f.category",
        mask_value(F.col("f.value")).alias("masked_value"), "f.severity",
        whole_percent(F.col("f.confidence")).alias("confidence"),
        F.expr(_case("f.severity", SEVERITY_SENTENCES, SEVERITY_DEFAULT)).alias("explanation"),
        F.expr(action_for("f.category")).alias("next_action"),
    )


def _row(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def _closing_priority() -> str:
    return "IF(risk_level = 'High Risk', 'P1', 'P2')"


def _plan_sql() -> str:
    """Rows in order; (priority, action) pairs are distinct by construction of the
    rule table, so no later row can repeat an earlier one."""
    high = "array_sort(array_distinct(transform(filter(findings, f -> f.severity = 'High'), f -> f.category)))"
    exposure = f"concat('High-severity exposure: ', array_join({high}, ', '), '.')"
    rows = [
        f"IF(n_high > 0, "
        f"{_row(priority=quote('P0'), action=quote(PLAN_QUARANTINE), evidence=exposure)}, NULL)"
    ]
    rows += [
        f"IF({any_of('categories', cats)}, "
        f"{_row(priority=quote(p), action=quote(a), evidence=quote(e))}, NULL)"
        for cats, p, a, e in PLAN_RULES
    ]
    found = "concat('Detected categories: ', array_join(array_sort(categories), ', '), '.')"
    rows.append(
        f"IF(n_findings > 0, {_row(priority=quote('P2'), action=quote(PLAN_EXPORT), evidence=found)}, NULL)"
    )
    signal = "concat('NLP signal: ', coalesce(nullif(array_join(slice(semantic_labels, 1, 3), ', '), ''), nlp_status), '.')"
    rows.append(_row(priority=_closing_priority(), action=quote(PLAN_RECORD), evidence=signal))
    return present(rows)


def _review_sql() -> str:
    rows = [
        f"IF({any_of('categories', cats)}, "
        + _row(owner=quote(owner), task=quote(task), status="'Open'", priority=quote(p),
               evidence=quote(e))
        + ", NULL)"
        for cats, owner, task, p, e in REVIEW_RULES
    ]
    rows.append(
        _row(owner="'Compliance'", task=quote(REVIEW_FINAL_TASK), status="'Open'",
             priority=_closing_priority(),
             evidence="concat(risk_level, '; NLP mode ', nlp_status, '.')")
    )
    return present(rows)


def with_nlp_defaults(assessed: DataFrame) -> DataFrame:
    """Add nlp_status and semantic_labels where no semantic model ran."""
    out = assessed
    if "nlp_status" not in out.columns:
        out = out.withColumn("nlp_status", F.lit("Standard NLP"))
    if "semantic_labels" not in out.columns:
        out = out.withColumn("semantic_labels", F.array().cast("array<string>"))
    return out


def action_plan(assessed: DataFrame) -> DataFrame:
    rows = with_nlp_defaults(assessed).select(
        "doc_id", F.posexplode(F.expr(_plan_sql())).alias("i", "r")
    )
    return rows.select("doc_id", (F.col("i") + 1).alias("row_no"), "r.*")


def reviewer_workflow(assessed: DataFrame) -> DataFrame:
    rows = with_nlp_defaults(assessed).select(
        "doc_id", F.posexplode(F.expr(_review_sql())).alias("i", "r")
    )
    return rows.select("doc_id", (F.col("i") + 1).alias("row_no"), "r.*")


def policy_keywords(control: str, recommendation: str) -> list[str]:
    """Words longer than five characters; punctuation stays attached."""
    return [w for w in f"{control} {recommendation}".lower().split() if len(w) > 5]


def _policy_sql(evidence: str) -> str:
    rows = []
    for i, (control, cats, recommendation) in enumerate(POLICY_CONTROLS):
        matched = _matched(cats) if cats else "array_sort(categories)"
        rows.append(
            _row(
                row_no=str(i + 1), control=quote(control),
                triggered_by=_matched_text(matched, "No direct trigger"),
                policy_evidence=evidence.format(i=i),
                recommendation=quote(recommendation), priority=_priority(matched),
            )
        )
    return f"array({', '.join(rows)})"


def match_policies(policies: DataFrame) -> DataFrame:
    """Per policy text, which baseline controls it speaks to (once per policy)."""
    tests = [
        " OR ".join(
            f"contains(lower(text), {quote(w)})" for w in policy_keywords(control, recommendation)
        )
        for control, _, recommendation in POLICY_CONTROLS
    ]
    return policies.selectExpr(
        "policy_id", "text <> '' AS has_policy", f"array({', '.join(tests)}) AS control_hits"
    )


def policy_check(assessed: DataFrame, policies: DataFrame | None = None) -> DataFrame:
    """Compare each document with the baseline controls.

    Without ``policies`` the built-in baseline is the evidence. With policies
    ``(policy_id, text)``, rows are matched on ``policy_id``, which the
    documents must carry; policy text is reduced to flags before the join.
    """
    if policies is None:
        return assessed.select("doc_id", F.inline(F.expr(_policy_sql("'Built-in baseline'"))))
    evidence = (
        "CASE WHEN NOT coalesce(has_policy, false) THEN 'Built-in baseline' "
        "WHEN control_hits[{i}] THEN 'Matched uploaded policy' ELSE 'No clear policy match' END"
    )
    from docwarden.operators.scale import salted_lookup

    narrow = assessed.select("doc_id", "policy_id", "categories", "risk_level")
    joined = salted_lookup(narrow, match_policies(policies), ["policy_id"], F.col("doc_id"))
    return joined.select("doc_id", "policy_id", F.inline(F.expr(_policy_sql(evidence))))


def policy_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i + 1, *row) for i, row in enumerate(POLICY_CATALOGUE)],
        "row_no int, policy string, trigger string, control string",
    )


def final_report(
    summarized: DataFrame,
    title: str = "Document compliance report",
    ai_status: str = "Standard analysis",
    evidence_rows: int | None = REPORT_EVIDENCE,
) -> DataFrame:
    """Add ``report``: the section-ordered text report of each document.

    It shows the first ``evidence_rows`` findings; None shows all.
    """
    masked = F.transform(
        first_items("findings", evidence_rows),
        lambda f: F.concat(
            F.lit("- "), F.col("file_name"), F.lit(": "), f["category"], F.lit(" | "),
            mask_value(f["value"]), F.lit(" | "), f["severity"], F.lit(" | "), f["reason"],
        ),
    )
    staged = with_nlp_defaults(summarized).selectExpr(
        "*", f"{_frameworks_sql()} AS _fw", f"{_plan_sql()} AS _plan",
        f"{_review_sql()} AS _review",
        f"{_policy_sql(quote('Built-in baseline'))} AS _policy",
    ).withColumn("_evidence", masked)

    def bullets(source: str, line: str) -> str:
        return f"transform({source}, r -> {line})"

    head = string_array([title, "", "Executive Summary"])
    facts = f"""array(concat('Document: ', file_name), concat('File type: ', file_type),
      concat('Risk: ', risk_level, ' (', risk_score, '/100)'),
      concat('Findings: ', n_findings, ' sensitive item(s)'),
      concat('AI mode: ', {quote(ai_status)}), concat('NLP mode: ', nlp_status))"""
    none_found = "array('- No configured sensitive data detected.')"
    counted = bullets("ranked", "concat('- ', r.category, ': ', r.n)")
    pieces = [
        head, facts, string_array(["", "Detected Categories"]),
        f"IF(n_findings = 0, {none_found}, {counted})",
        string_array(["", "Compliance Observations"]), bullets("observations", "concat('- ', r)"),
        string_array(["", "Security Risks"]), bullets("security_risks", "concat('- ', r)"),
        string_array(["", "Suggested Remediation"]), bullets("remediation", "concat('- ', r)"),
        string_array(["", "Framework Mapping"]),
        bullets("_fw", "concat('- ', r.framework, ': ', r.matched, ' | ', r.recommended_control)"),
        string_array(["", "Action Plan"]),
        bullets("_plan", "concat('- ', r.priority, ': ', r.action, ' Evidence: ', r.evidence)"),
        string_array(["", "Reviewer Workflow"]),
        bullets("_review",
                "concat('- ', r.priority, ' / ', r.owner, ': ', r.task, ' (', r.status, ')')"),
        string_array(["", "Policy Check"]),
        bullets("_policy",
                "concat('- ', r.control, ': ', r.triggered_by, ' | ', r.recommendation)"),
        string_array(["", "Finding Evidence"]), "_evidence",
        string_array([
            "", "Audit Note",
            "This report uses masked findings and redacted context. Raw sensitive values should "
            "not be shared externally.",
        ]),
    ]
    report = f"array_join(flatten(array({', '.join(pieces)})), '\\n')"
    return staged.selectExpr("*", f"{report} AS report").drop(
        "_fw", "_plan", "_review", "_policy", "_evidence"
    )


def record_decisions(decisions: DataFrame) -> DataFrame:
    """Reviewer decisions as audit events; rows with an unknown status are dropped.

    ``decisions``: user_id, analysis_id, status, owner, note, risk, detections,
    created_at.
    """
    valid = decisions.where(F.col("status").isin(*REVIEW_STATUSES))
    details = F.to_json(
        F.struct("analysis_id", "status", "owner", "note", "risk", "detections")
    )
    return valid.select(
        "user_id", F.lit("reviewer_decision_recorded").alias("event_type"),
        details.alias("details"), "created_at",
    )


def rejected_decisions(decisions: DataFrame) -> DataFrame:
    return decisions.where(~F.coalesce(F.col("status").isin(*REVIEW_STATUSES), F.lit(False)))
