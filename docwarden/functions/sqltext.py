"""Helpers that write small pieces of Spark SQL expression text."""

from __future__ import annotations

from collections.abc import Iterable


def quote(value: str) -> str:
    """A Spark SQL string literal."""
    escaped = (
        value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t")
        .replace("\r", "\\r")
    )
    return f"'{escaped}'"


def string_array(values: Iterable[str]) -> str:
    items = ", ".join(quote(v) for v in values)
    return f"array({items})" if items else "cast(array() AS array<string>)"


def any_of(array_column: str, values: Iterable[str]) -> str:
    """True when ``array_column`` holds any of ``values``."""
    return f"arrays_overlap({array_column}, {string_array(values)})"


def present(items: Iterable[str]) -> str:
    """Array of the non-null items, in order."""
    return f"filter(array({', '.join(items)}), x -> x IS NOT NULL)"
