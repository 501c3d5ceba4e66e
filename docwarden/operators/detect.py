"""Sensitive-data detection: documents in, findings out.

``scan`` adds the ``findings`` array to every document row with column
expressions only. No shuffle and no Python worker is involved, so the cost is
one pass over the text and it scales with the number of input splits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.catalog import (
    DETECTORS, FIRST_CONTEXTUAL, MODEL_ENTITY_LABELS, MODEL_ORG_STOP_VALUES, PATTERNS,
)
from docwarden.functions.masking import mask_value
from docwarden.functions.once import computed_once
from docwarden.functions.spans import (
    MARK, clean_contextual, digits_from, has_odd_case, match_copy, match_spans, resolve_overlaps,
    text_from,
)
from docwarden.functions.sqltext import quote
from docwarden.functions.text import strip, whole_percent
from docwarden.functions.validators import aadhaar_valid, card_valid

FINDING = (
    "struct<category:string,value:string,start:int,end:int,severity:string,"
    "confidence:double,reason:string>"
)
_CARD = next(i for i, p in enumerate(PATTERNS) if p.category == "Credit Card Number")
_AADHAAR = next(i for i, p in enumerate(PATTERNS) if p.category == "Aadhaar Number")


def spread(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal documents out anew when the input has fewer splits than the cluster has cores.

    An input of at least as many splits is left alone, so what is shuffled is at most one split per
    core. Rows are dealt without a key: no value can make a task hot.
    """
    wanted = partitions or docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= wanted else docs.repartition(wanted)


def _meta() -> str:
    rows = ", ".join(
        f"named_struct('c', {quote(d.category)}, 'sev', {quote(d.severity)}, "
        f"'conf', {d.confidence}D, 'why', {quote(d.reason)})"
        for d in DETECTORS
    )
    return f"array({rows})"


def candidates(docs: DataFrame, only: Iterable[str] | None = None) -> DataFrame:
    """Add ``candidates``: validated matches of every detector, overlaps kept.

    ``only`` limits the work to some categories.
    """
    chosen = [
        (i, d) for i, d in enumerate(DETECTORS) if only is None or d.category in set(only)
    ]
    prepared = docs.withColumns({"_match": match_copy(F.col("text"))}).withColumns(
        {"_lower": F.lower("_match"), "_odd": has_odd_case(F.col("_match")),
         "_start": digits_from(F.col("_match"))}
    ).withColumn("_match_rest", text_from(F.col("_match"), F.col("_start")))
    matched = prepared.withColumn("_spans", match_spans(
        chosen, F.col("_match"), F.col("_lower"), F.col("_odd"), (F.col("_start"), F.col("_match_rest"))
    ))
    checked = F.expr(
        f"""filter(_spans, c -> CASE c.p
              WHEN {_CARD} THEN {card_valid('c.v')}
              WHEN {_AADHAAR} THEN {aadhaar_valid('c.v')}
              ELSE true END)"""
    )
    cleaned = F.expr(
        f"""filter(transform(_spans, c -> IF(c.p >= {FIRST_CONTEXTUAL},
              named_struct('s', c.s, 'p', c.p, 'e', c.e, 'v', {clean_contextual('c.v')}), c)),
              c -> c.v <> '')"""
    )
    return (
        matched.withColumn("_spans", checked)
        .withColumn("candidates", cleaned)
        .drop("_match", "_lower", "_odd", "_start", "_match_rest", "_spans")
    )


def scan(docs: DataFrame, only: Iterable[str] | None = None) -> DataFrame:
    """Add ``findings``: non-overlapping detections ordered by start."""
    resolved = candidates(docs, only).withColumn(
        "_kept", resolve_overlaps(F.col("candidates"))
    ).withColumn(
        "_found", F.expr(f"transform(_kept, k -> named_struct('k', k, 'm', {_meta()}[k.p]))")
    )

    def listed(value: str) -> str:
        return f"""transform(_found, f -> named_struct(
              'category', f.m.c, 'value', {value}, 'start', f.k.s, 'end', f.k.e,
              'severity', f.m.sev, 'confidence', f.m.conf, 'reason', f.m.why))"""

    # Texts that hold the mark were matched on a copy; quote the original there.
    original = f"IF(f.k.p < {FIRST_CONTEXTUAL}, substring(text, f.k.s + 1, f.k.e - f.k.s), f.k.v)"
    findings = F.expr(f"IF(contains(text, '{MARK}'), {listed(original)}, {listed('f.k.v')})")
    return computed_once(resolved, {"findings": findings}).drop("_found", "_kept", "candidates")


def explode_findings(scans: DataFrame, *keys: str) -> DataFrame:
    """One row per finding: the narrow fact table downstream queries use.

    ``keys`` are the document columns to keep (default: all but the text).
    """
    keys = keys or tuple(c for c in scans.columns if c not in ("text", "findings"))
    return scans.select(*keys, F.inline("findings"))


def findings_view(facts: DataFrame) -> DataFrame:
    """Display projection with masked values and whole-percent confidence."""
    return facts.select(
        F.col("file_name").alias("document"),
        "category",
        mask_value(F.col("value")).alias("masked_value"),
        "severity",
        whole_percent(F.col("confidence")).alias("confidence"),
        "reason",
    )


def filter_findings(
    facts: DataFrame,
    categories: Iterable[str] | None = None,
    severities: Iterable[str] | None = None,
    documents: Iterable[str] | None = None,
) -> DataFrame:
    """``IN`` filters; a filter that is not given keeps everything."""
    out = facts
    for column, wanted in (("category", categories), ("severity", severities),
                           ("file_name", documents)):
        if wanted is not None:
            out = out.where(F.col(column).isin(list(wanted)))
    return out


def filter_options(facts: DataFrame) -> DataFrame:
    """Distinct values offered by each filter, as (filter, option) rows."""
    pairs = facts.select(
        F.inline(
            F.array(*[
                F.struct(F.lit(name).alias("filter"), F.col(col).alias("option"))
                for name, col in (("category", "category"), ("severity", "severity"),
                                  ("document", "file_name"))
            ])
        )
    )
    return pairs.distinct()


def _entity_findings() -> Column:
    """Model entities that pass the label, length, stop-value and overlap rules."""
    labels = F.create_map(*[F.lit(x) for kv in MODEL_ENTITY_LABELS.items() for x in kv])

    def wide(e: Column) -> Column:
        return F.struct(
            F.try_element_at(labels, e["label"]).alias("category"),
            strip(e["text"]).alias("value"),
            e["start"].alias("start"), e["end"].alias("end"),
            F.lit("Medium").alias("severity"), F.lit(0.72).alias("confidence"),
            F.concat(F.lit("spaCy NER model identified "), e["label"],
                     F.lit(" entity in document context.")).alias("reason"),
        )

    def usable(f: Column) -> Column:
        stop = (f["category"] == "Organization Name") & F.lower(f["value"]).isin(
            *MODEL_ORG_STOP_VALUES
        )
        return f["category"].isNotNull() & (F.length(f["value"]) >= 3) & ~stop

    def add(kept: Column, f: Column) -> Column:
        clash = F.exists(kept, lambda k: (f["start"] < k["end"]) & (f["end"] > k["start"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(f)))

    usable_entities = F.filter(F.transform("entities", wide), usable)
    return F.aggregate(usable_entities, F.col("findings"), add)


def add_model_entities(scans: DataFrame, entities: DataFrame) -> DataFrame:
    """Merge external entity-model output ``(doc_id, entities)`` into findings.

    ``entities`` is array<struct<label,text,start,end>> in model order, usually
    produced with ``mapInPandas``. Documents without model output stay as they
    are. One row per document on both sides, so the join has no hot key.
    """
    joined = scans.join(entities, "doc_id", "left").withColumn(
        "_merged", F.when(F.col("entities").isNull(), F.col("findings")).otherwise(
            _entity_findings()
        )
    )
    return _in_output_order(joined).drop("entities")


def _in_output_order(merged: DataFrame) -> DataFrame:
    ordered = F.array_sort(
        "_merged",
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"])
        .when(a["category"] < b["category"], -1).otherwise(1),
    )
    return merged.withColumn("findings", ordered).drop("_merged")


#: Characters of one window handed to an entity model, and of the stretch two windows share.
MODEL_WINDOW, MODEL_OVERLAP = 100_000, 2_000


def model_windows(text: str, window: int = MODEL_WINDOW, overlap: int = MODEL_OVERLAP):
    """``(at, piece, low, high)``: windows of a text and the part of it whose entities each decides.

    Windows share ``overlap`` characters; an entity belongs to the window in which its start lies
    farther from the edge, so one that a cut would divide is seen whole by its window.
    """
    step = window - overlap
    for at in range(0, max(1, len(text) - overlap), step):
        last = at + window >= len(text)
        yield (at, text[at: at + window], at + overlap // 2 if at else 0,
               len(text) if last else at + step + overlap // 2)


def free_entities(entities, taken):
    """Entities, in model order, that overlap neither a taken span nor an entity kept before.

    ``taken`` and what is kept stay sorted and disjoint, so each entity is placed by bisection."""
    from bisect import bisect_right, insort

    spans = []
    for start, end in sorted(taken):  # findings of several detectors may touch or overlap
        if spans and start < spans[-1][1]:
            spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
        else:
            spans.append((start, end))
    for entity in entities:
        _, _, start, end = entity
        at = bisect_right(spans, (start, float("inf")))
        before = at and spans[at - 1][1] > start
        if not before and (at == len(spans) or spans[at][0] >= end):
            insort(spans, (start, end))
            yield entity


def with_model_entities(
    scans: DataFrame, load: Callable[[], Callable], window: int = MODEL_WINDOW, overlap: int = MODEL_OVERLAP
) -> DataFrame:
    """Add an entity model's findings to those of the detectors.

    ``load`` makes the model, once per Python worker; the model takes a text and returns
    ``(label, text, start, end)`` tuples. Whole texts are read, in windows, and only texts and spans
    go to the worker. Entities with a known label, three characters and no stop value are kept where
    they overlap no finding and no earlier entity.
    """
    labels, stops = dict(MODEL_ENTITY_LABELS), set(MODEL_ORG_STOP_VALUES)

    def usable(label: str, value: str) -> bool:
        return label in labels and len(value) >= 3 and not (
            labels[label] == "Organization Name" and value.lower() in stops)

    def entities_of(model, text: str, taken) -> list[dict]:
        found = []
        for at, piece, low, high in model_windows(text, window, overlap):
            for label, value, start, end in model(piece):
                value = value.strip()
                if low <= start + at < high and usable(label, value):
                    found.append((label, value, start + at, end + at))
        return [dict(zip(("label", "text", "start", "end"), e)) for e in free_entities(found, taken)]

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = load()
        kind = pa.list_(pa.struct([("label", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for texts, starts, ends in batches:
            rows = zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist())
            yield pa.array([entities_of(model, t or "", zip(s or [], e or [])) for t, s, e in rows], kind)

    hook = F.arrow_udf(run, "array<struct<label:string,text:string,start:int,end:int>>")
    found = computed_once(scans, {"_entities": hook(F.col("text"), F.col("findings.start"), F.col("findings.end"))})
    label = F.create_map(*[F.lit(x) for kv in MODEL_ENTITY_LABELS.items() for x in kv])
    wide = F.transform("_entities", lambda e: F.struct(
        label[e["label"]].alias("category"), e["text"].alias("value"), e["start"].alias("start"), e["end"].alias("end"),
        F.lit("Medium").alias("severity"), F.lit(0.72).alias("confidence"),
        F.concat(F.lit("spaCy NER model identified "), e["label"], F.lit(" entity in document context.")).alias("reason")))
    return _in_output_order(found.withColumn("_merged", F.concat("findings", wide))).drop("_entities")
