"""Masking and redaction expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.functions.once import computed_once
from docwarden.functions.text import piece_substring, pieces, strip


def mask_value(value: Column) -> Column:
    """All stars up to four characters, else two visible at each end."""
    v = strip(value)
    n = F.length(v)
    hidden = F.greatest(F.lit(4), n - F.least(F.lit(4), F.ceil(n * F.lit(0.25)).cast("int")))
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.left(v, F.lit(2)), F.repeat(F.lit("*"), hidden), F.right(v, F.lit(2)))
    )


def redact(text: Column, cut: Column, findings: Column) -> Column:
    """Replace each finding by ``[REDACTED <CATEGORY>]``.

    Findings must not overlap and must be ordered by start, which is how the
    detector returns them. Each one contributes the gap before it and its
    label; the parts are joined once, so nothing is rebuilt per finding.
    ``cut`` is ``pieces(text)``.
    """
    n = F.size(findings)

    def part(f: Column, i: Column) -> Column:
        gap_start = F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(findings, i)["end"])
        return F.concat(
            piece_substring(cut, gap_start, f["start"] - gap_start),
            F.lit("[REDACTED "), F.upper(f["category"]), F.lit("]"),
        )

    tail = F.substring(text, F.try_element_at(findings, n)["end"] + 1, F.lit(2**31 - 1))
    return F.when(n > 0, F.concat(F.array_join(F.transform(findings, part), ""), tail)).otherwise(
        text
    )


def redacted(scans: DataFrame) -> DataFrame:
    """Add ``redacted_text`` next to the original."""
    cut = computed_once(scans, {"_cut": pieces(F.col("text"))})
    safe = redact(F.col("text"), F.col("_cut"), F.col("findings"))
    return computed_once(cut, {"redacted_text": safe}).drop("_cut")
