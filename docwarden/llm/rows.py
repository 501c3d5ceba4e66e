"""Names and keys for rows of tables whose other columns are not known."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows without an id of their own are numbered from here on.
FIRST_MADE_ID = 1 << 62


def free_name(columns: Iterable[str], base: str) -> str:
    """A column name that is not taken, whatever the case of the others."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def row_key(rows: DataFrame) -> Column:
    """A 128-bit hash of a whole row; only equal rows agree."""
    def hashable(name: str, kind: str) -> Column:
        column = F.col(f"`{name}`")
        return F.to_json(F.struct(column)) if "map<" in kind or "variant" in kind else column

    columns = [hashable(*pair) for pair in rows.dtypes]
    # a null and a shift of values to the next column must differ
    nulls = F.concat(*[F.col(f"`{c}`").isNull().cast("string") for c in rows.columns])
    return F.struct(F.xxhash64(nulls, *columns).alias("a"), F.xxhash64(F.lit(1), nulls, *columns).alias("b"))


def with_row_ids(rows: DataFrame, name: str, doc_id: str, repeated: DataFrame | None) -> DataFrame:
    """Add ``name``: the id where it is one row's own, else a number made from the row's key, which
    equal rows share. ``repeated`` has the column ``again`` of ids of several rows, if there are any."""
    key = F.col(f"`{doc_id}`").cast("long")
    made = F.lit(FIRST_MADE_ID) + row_key(rows)["a"].bitwiseAND(F.lit(FIRST_MADE_ID - 1))
    if repeated is None:
        return rows.withColumn(name, F.coalesce(key, made))
    again = free_name([*rows.columns, name], "again")
    known = repeated.select(F.col("again").alias(again))
    joined = rows.withColumn(name, F.coalesce(key, made)).join(known, key == F.col(again), "left")
    return joined.withColumn(name, F.when(F.col(again).isNull(), F.col(name)).otherwise(made)).drop(again)
