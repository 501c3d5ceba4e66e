"""Fact tables: appended by run, read by date, with columns that were added over time.

A run's rows are partitioned by date and run, and writing a run again replaces its own partitions, so
a retried append leaves one set of rows. Readers filter on ``created_date``, which skips folders.

A table's schema grows by adding columns. Readers name the columns they want and what a column holds
in files written before it existed; Spark fills that in while it reads, so a null that was written
stays null. Columns that files have beyond these are kept. A column whose type changed is an error
that names it.
"""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: Types a reader may widen to another one.
WIDER = {("int", "bigint"), ("smallint", "int"), ("smallint", "bigint"), ("float", "double"), ("int", "double")}


class ChangedColumn(ValueError):
    """Files of one table hold a column with types that do not go together."""


def append_facts(rows: DataFrame, path: str, run: str) -> None:
    """Write the rows of a run; rows of the same run and dates are replaced."""
    rows.withColumns({"created_date": F.to_date("created_at"), "run": F.lit(run)}).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("created_date", "run").parquet(path)


def with_defaults(schema: StructType | str, defaults: dict[str, str] | None = None) -> StructType:
    """``schema`` whose columns read as the SQL literals in ``defaults`` where a file lacks them."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    defaults = defaults or {}
    unknown = set(defaults) - set(schema.names)
    if unknown:
        raise ValueError(f"defaults for columns that are not in the schema: {sorted(unknown)}")
    return StructType([
        StructField(f.name, f.dataType, f.nullable, {
            **(f.metadata or {}),
            **({"CURRENT_DEFAULT": defaults[f.name], "EXISTS_DEFAULT": defaults[f.name]} if f.name in defaults else {}),
        }) for f in schema])


def found_schema(spark: SparkSession, path: str) -> StructType:
    """The merged schema of all files, or an error that names the columns that do not merge."""
    try:
        return spark.read.option("mergeSchema", "true").parquet(path).schema
    except Exception as error:
        kinds = [StructType.fromDDL(found) for found in re.findall(r'"STRUCT<(.*)>"', str(error))]
        if "CANNOT_MERGE_SCHEMAS" not in str(error) or len(kinds) != 2:
            raise
        one, other = ({f.name: f.dataType.simpleString() for f in kind} for kind in kinds)
        changed = sorted(c for c in one if c in other and one[c] != other[c])
        raise ChangedColumn("; ".join(
            f"column {c} is {one[c]} in some files and {other[c]} in others" for c in changed)) from error


def _readable(found: DataType, asked: DataType) -> bool:
    names = found.simpleString(), asked.simpleString()
    return names[0] == names[1] or names in WIDER


def read_facts(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    defaults: dict[str, str] | None = None,
    since: datetime.date | str | None = None,
    until: datetime.date | str | None = None,
) -> DataFrame:
    """The table's rows of the dates ``since`` to ``until`` (both included).

    Columns come in the order of ``schema``, then others that files have."""
    asked, there = with_defaults(schema, defaults), found_schema(spark, path)
    known = {f.name: f for f in asked}
    for field in there:
        if field.name in known and not _readable(field.dataType, known[field.name].dataType):
            raise ChangedColumn(
                f"column {field.name} is {field.dataType.simpleString()} in the files, "
                f"{known[field.name].dataType.simpleString()} was asked for")
    whole = StructType([*asked, *[f for f in there if f.name not in known]])
    rows = spark.read.schema(whole).parquet(path)
    for bound, keep in ((since, Column.__ge__), (until, Column.__le__)):
        if bound is not None:
            rows = rows.where(keep(F.col("created_date"), F.lit(str(bound)).cast("date")))
    return rows
