"""Building blocks that stay balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docwarden.session import stored

DEFAULT_SALT = 16


def salted_lookup(
    rows: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    spread_by: Column,
    how: str = "left",
    salt: int = DEFAULT_SALT,
) -> DataFrame:
    """Join many rows to at most one lookup row per key, splitting hot keys.

    Each row gets one of ``salt`` sub-keys from ``spread_by``; every lookup row
    is repeated once per sub-key. A hot key is then spread over ``salt`` tasks
    before adaptive execution splits what is still too large. When the lookup
    is small by Spark's own size check it is broadcast and no shuffle happens.
    """
    sub_key = F.pmod(F.xxhash64(spread_by), F.lit(salt)).cast("int")
    many = rows.withColumn("_salt", sub_key)
    one = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return many.join(one, [*keys, "_salt"], how).drop("_salt")


def range_cut(rows: DataFrame, *sort: str, partitions: int | None = None) -> DataFrame:
    """Add ``_part``, rising with ``sort``: the number of the row's range partition.

    Rows are stored twice, so keep them narrow: range partitioning reads its input once more for a
    sample, which must not be the documents again, and all later steps need the same cuts.
    """
    narrow = stored(rows)
    columns = [F.col(c) for c in sort]
    spread = narrow.repartitionByRange(*columns) if partitions is None else narrow.repartitionByRange(
        partitions, *columns)
    return stored(spread.withColumn("_part", F.spark_partition_id()))


def ordered_prefix(
    rows: DataFrame, group: str, order: str, amounts: dict[str, Column], partitions: int | None = None
) -> DataFrame:
    """Add running totals of earlier rows per group: a distributed prefix sum.

    ``order`` is unique inside a group and of any orderable type, dense or not. Rows are
    range-partitioned by group and order, so a large group spans many partitions of about equal
    size. Each partition's totals are taken per group, a scan over one row per partition and group
    gives the totals of earlier partitions, and inside a partition running totals are added to them.
    No window is larger than a range partition: that of the input divided by ``partitions``, or by
    the session's number, which adaptive execution lowers to what its advisory size holds.

    """
    placed = range_cut(
        rows.withColumns({f"_amt_{name}": amount for name, amount in amounts.items()}),
        group, order, partitions=partitions)
    totals = placed.groupBy(group, "_part").agg(
        *[F.sum(f"_amt_{name}").alias(f"_tot_{name}") for name in amounts])
    across = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(group, "_part", *[
        F.coalesce(F.sum(f"_tot_{name}").over(across), F.lit(0)).alias(f"_base_{name}") for name in amounts])
    within = Window.partitionBy(group, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumns(
        {name: F.coalesce(F.sum(f"_amt_{name}").over(within), F.lit(0)) for name in amounts}
    ).drop(*[f"_amt_{name}" for name in amounts])
    base = bases.withColumnRenamed(group, "_group").withColumnRenamed("_part", "_of")
    joined = inside.join(base, inside[group].eqNullSafe(base["_group"]) & (F.col("_part") == F.col("_of")))
    return joined.withColumns(
        {name: F.col(name) + F.col(f"_base_{name}") for name in amounts}
    ).drop("_part", "_of", "_group", *[f"_base_{name}" for name in amounts])
