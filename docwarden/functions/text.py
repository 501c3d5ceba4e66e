"""Text helpers as column expressions (no Python in the executors)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docwarden.catalog import SPACE

TERM = "[a-zA-Z][a-zA-Z0-9_]{2,}"


def strip(text: Column) -> Column:
    """Drop Unicode whitespace from both ends."""
    return F.regexp_replace(text, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def first_items(items: Column | str, limit: int | None) -> Column:
    """The first ``limit`` items of an array; None keeps all."""
    items = F.col(items) if isinstance(items, str) else items
    return items if limit is None else F.slice(items, 1, limit)


def first_chars(text: Column | str, limit: int | None) -> Column:
    """The first ``limit`` characters; None keeps the whole text."""
    text = F.col(text) if isinstance(text, str) else text
    return text if limit is None else F.left(text, F.lit(limit))


def compact(text: Column) -> Column:
    """Collapse whitespace runs to one space and trim.

    Runs that are one space already, nearly all of them, are not matched: nothing is copied for them.
    """
    return F.btrim(F.regexp_replace(text, f" [{SPACE}]++|[{SPACE}&&[^ ]][{SPACE}]*+", " "), F.lit(" "))


def compact_text(text: Column, max_chars: int | None = None) -> Column:
    return first_chars(compact(text), max_chars)


def terms(text: Column) -> Column:
    """Lower-case words of three or more ASCII characters, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"))


def count_of(lowered: Column, term: str) -> Column:
    """Non-overlapping occurrences of a fixed term in lower-case text."""
    return F.when(
        F.contains(lowered, F.lit(term)),
        ((F.length(lowered) - F.length(F.replace(lowered, F.lit(term), F.lit("")))) / len(term))
        .cast("int"),
    ).otherwise(F.lit(0))


def whole_percent(fraction: Column) -> Column:
    """``0.98 -> '98%'``; exact halves go to the even neighbour.

    The double is widened exactly before rounding, so 0.145 (slightly below
    the half in binary) and 0.125 (an exact half) both come out right.
    """
    return F.concat(F.bround(fraction.cast("decimal(38,30)") * 100, 0).cast("int"), F.lit("%"))


def escape_html(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"),
                      ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def safe_file_name(name: Column) -> Column:
    """Letters, numbers, ``_`` and ``-`` stay; anything else becomes ``_``."""
    cleaned = F.btrim(F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_"), F.lit("_"))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("export"))


PIECE = 4_096


def pieces(text: Column, size: int = PIECE) -> Column:
    """The text cut every ``size`` characters, in one pass."""
    return F.when(F.length(text) <= size, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{size}}})"))
    )


def piece_substring(cut: Column, start: Column, length: Column, size: int = PIECE) -> Column:
    """Substring (0-based start) that only touches the pieces it spans.

    A plain ``substring`` walks a UTF-8 text from its beginning every time,
    which is quadratic when a long text is taken apart.
    """
    first = F.floor(start / size).cast("int")
    local = start - first * size
    span = F.floor((local + length + size - 1) / size).cast("int")
    joined = F.array_join(F.slice(cut, first + 1, F.greatest(span, F.lit(1))), "")
    return F.substring(joined, local + 1, length)
