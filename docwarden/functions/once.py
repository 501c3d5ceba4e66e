"""Columns that are evaluated exactly once per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns behind a one-row generator.

    The optimizer moves a later filter (also one it derives from ``explode``)
    below the projection that defines its columns and repeats their expressions
    there. For costly columns that means doing the work twice. Filters do not
    pass a generator's output, and unused columns are still pruned through it.
    The same goes for a column that a later lambda uses: it would be moved into
    the lambda and evaluated per array element.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))


def named(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)
