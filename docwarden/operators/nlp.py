"""Text signals and chunking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.catalog import (
    CHUNK_OVERLAP, CHUNK_SIZE, KEYWORD_SIGNALS, Pattern, RULER_PHRASES, SEMANTIC_SOURCE,
)
from docwarden.functions.once import computed_once
from docwarden.functions.spans import has_odd_case, match_copy, match_spans
from docwarden.functions.sqltext import string_array
from docwarden.functions.text import compact, compact_text, count_of, first_items

RULER_LIMIT = 25
SIGNAL_LIMIT = 5
MODEL_INPUT_CHARS = 3_000


def keyword_signals(docs: DataFrame) -> DataFrame:
    """(doc_id, row_no, label, text, count) for every listed term that occurs."""
    listed = [(label, t) for label, terms in KEYWORD_SIGNALS for t in terms]
    lowered = docs.select("doc_id", F.lower("text").alias("_low"))
    rows = lowered.select(
        "doc_id",
        F.inline(F.array(*[
            F.struct(F.lit(i + 1).alias("row_no"), F.lit(label).alias("label"),
                     F.lit(t).alias("text"), count_of(F.col("_low"), t).alias("count"))
            for i, (label, t) in enumerate(listed)
        ])),
    )
    return rows.where(F.col("count") > 0)


def ruler_signals(docs: DataFrame, limit: int = RULER_LIMIT) -> DataFrame:
    """Whole-word phrase hits per (label, surface text), most frequent first.

    Ties keep the order of first appearance. The whole text is used.
    """
    phrases = [
        (i, Pattern(label, rf"(?=[{p[0]}{p[0].upper()}İıſ])(?<!\w)", p, r"(?!\w)",
                    "", 0.0, "", ignore_case=True, words=(p,)))
        for i, (label, p) in enumerate(RULER_PHRASES)
    ]
    labels = string_array([label for label, _ in RULER_PHRASES])
    matched = (
        docs.select("doc_id", match_copy(F.col("text")).alias("_t"))
        .withColumns({"_low": F.lower("_t"), "_odd": has_odd_case(F.col("_t"))})
        .withColumn("_spans", match_spans(phrases, F.col("_t"), F.col("_low"), F.col("_odd")))
        .select("doc_id", F.expr(
            f"transform(sort_array(_spans), s -> named_struct('label', {labels}[s.p], 'text', s.v))"
        ).alias("_hits"))
    )
    ranked = matched.selectExpr(
        "doc_id",
        f"""slice(sort_array(transform(array_distinct(_hits), (h, i) -> named_struct(
              'k', -size(filter(_hits, x -> x = h)), 'i', i, 'h', h))), 1, {limit}) AS top""",
    )
    rows = ranked.select("doc_id", F.posexplode_outer("top").alias("i", "t")).where(
        F.col("t.k").isNotNull()
    )
    return rows.select(
        "doc_id", (F.col("i") + 1).alias("row_no"), F.col("t.h.label").alias("label"),
        F.col("t.h.text").alias("text"), (-F.col("t.k")).alias("count"),
    )


def semantic_input(docs: DataFrame, chars: int | None = MODEL_INPUT_CHARS) -> DataFrame:
    """Compacted text as handed to an external label scorer; None hands over all of it."""
    return docs.select(
        "doc_id", compact_text(F.col("text"), chars).alias("model_input")
    )


def semantic_signals(scored: DataFrame, limit: int | None = SIGNAL_LIMIT) -> DataFrame:
    """Pair scorer labels with scores, drop unparsable ones, keep the first ``limit``.

    ``scored``: doc_id, labels array<string>, scores array<string>, typically
    made with ``mapInPandas`` over ``semantic_input``.
    """
    shorter = F.least(F.size("labels"), F.size("scores"))
    paired = F.zip_with(
        F.slice("labels", 1, shorter), F.slice("scores", 1, shorter),
        lambda label, score: F.struct(
            label.alias("label"), score.try_cast("double").alias("score"),
            F.lit(SEMANTIC_SOURCE).alias("source"),
        ),
    )
    kept = first_items(F.filter(paired, lambda s: s["score"].isNotNull()), limit)
    return scored.select("doc_id", kept.alias("signals")).select(
        "*",
        F.transform("signals", lambda s: s["label"]).alias("semantic_labels"),
        F.when(F.size("signals") > 0, "Enhanced NLP").otherwise("Standard NLP").alias("nlp_status"),
    )


def run_scorer(docs: DataFrame, scorer) -> DataFrame:
    """Apply a user-supplied scorer: an iterator of pandas frames
    ``(doc_id, model_input)`` to frames ``(doc_id, labels, scores)``."""
    return semantic_input(docs).mapInPandas(
        scorer, "doc_id bigint, labels array<string>, scores array<string>"
    )


def chunk_array(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """array<(chunk_no, start, text)> over whitespace-compacted text.

    ``text`` must be compacted already. Windows of ``size`` start every
    ``step`` characters and stop once the end is reached. The text is cut into
    steps in one pass and each window is put together from the steps it spans.
    """
    step = max(1, size - overlap)
    spanned = -(-size // step)
    steps = F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{step}}})"))
    count = F.lit(1) + F.greatest(
        F.lit(0), F.ceil((F.length(text) - F.lit(size)) / F.lit(step)).cast("int")
    )

    def windows(cut: Column) -> Column:
        def window(i: Column) -> Column:
            raw = F.left(F.array_join(F.slice(cut, i + 1, spanned), ""), F.lit(size))
            return F.struct(
                i.alias("chunk_no"), (i * step).alias("start"),
                F.btrim(raw, F.lit(" ")).alias("text"),
            )

        return F.filter(
            F.transform(F.sequence(F.lit(0), count - 1), window), lambda c: c["text"] != ""
        )

    empty = F.array().cast("array<struct<chunk_no:int,start:int,text:string>>")
    return F.when(F.length(text) == 0, empty).otherwise(
        F.element_at(F.transform(F.array(steps), windows), 1)
    )


def with_chunks(
    docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """Add ``chunks`` to every document."""
    flat = docs.withColumn("_flat", compact(F.col("text")))
    return computed_once(flat, {"chunks": chunk_array(F.col("_flat"), size, overlap)}).drop("_flat")


def chunk_text(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """One row per chunk: doc_id, chunk_no, start, text."""
    return with_chunks(docs, size, overlap).select("doc_id", F.inline("chunks"))


def chunk_sentences(docs: DataFrame, max_terms: int = 200, overlap: int = 20) -> DataFrame:
    """Chunks of whole sentences.

    Sentences end at ``.``, ``!`` or ``?`` followed by whitespace. A chunk takes
    sentences while it has at most ``max_terms`` space-separated words (a longer
    sentence stands alone). The next chunk starts with the trailing sentences
    of the previous one that total at most ``overlap`` words and leave room.
    """
    words = lambda s: F.size(F.split(s, " "))

    def tail(current: Column, room: Column) -> Column:
        def back(a: Column, s: Column) -> Column:
            fits = ~a["full"] & (a["n"] + words(s) <= F.least(F.lit(overlap), room))
            return F.struct(
                F.when(fits, F.concat(F.array(s), a["kept"])).otherwise(a["kept"]).alias("kept"),
                F.when(fits, a["n"] + words(s)).otherwise(a["n"]).alias("n"),
                (~fits).alias("full"),
            )

        zero = F.struct(
            F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"),
            F.lit(False).alias("full"),
        )
        return F.aggregate(F.reverse(current), zero, back)

    def step(a: Column, s: Column) -> Column:
        fits = (F.size(a["cur"]) == 0) | (a["n"] + words(s) <= max_terms)
        kept = tail(a["cur"], F.lit(max_terms) - words(s))
        return F.struct(
            F.when(fits, a["done"])
            .otherwise(F.concat(a["done"], F.array(F.array_join(a["cur"], " ")))).alias("done"),
            F.when(fits, F.concat(a["cur"], F.array(s)))
            .otherwise(F.concat(kept["kept"], F.array(s))).alias("cur"),
            F.when(fits, a["n"] + words(s)).otherwise(kept["n"] + words(s)).alias("n"),
        )

    zero = F.struct(
        F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("cur"),
        F.lit(0).alias("n"),
    )
    sentences = docs.select(
        "doc_id", F.split(compact(F.col("text")), "(?<=[.!?]) +", -1).alias("s")
    )
    packed = sentences.select(
        "doc_id",
        F.aggregate(
            "s", zero, step, lambda a: F.concat(a["done"], F.array(F.array_join(a["cur"], " ")))
        ).alias("chunks"),
    )
    rows = packed.select("doc_id", F.posexplode_outer("chunks").alias("chunk_no", "text"))
    return rows.where(F.col("text") != "")
