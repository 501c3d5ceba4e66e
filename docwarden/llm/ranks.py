"""Places of rows inside their groups, for groups of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docwarden.llm.storage import stored

#: ``monotonically_increasing_id`` counts rows in the low bits, partitions above them.
ROW_BITS = 33


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``idx`` (from 0) inside its ``group`` by ``order``, and ``n``, the group's rows.

    A distributed prefix sum: rows are range-partitioned by group and order and sorted inside each
    partition, so a large group spans many partitions; a row's place is that in its partition plus
    the group's rows in earlier partitions, of which there is one count for each partition and
    group. ``order`` should end in a column that differs everywhere, so that equal rows can be cut
    apart. ``group`` must not be null; nulls in ``order`` come first.
    """
    sort = [group, *order]
    placed = stored(
        rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
        .withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", ROW_BITS)
    counts = placed.groupBy(group, part.alias("_part")).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    # one row per partition and group
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        group, "_part", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(whole).alias("n"))
    return placed.withColumn("_part", part).join(counts, [group, "_part"]).withColumn(
        "idx", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def runs(batches, *keys: str) -> Iterator[pa.Table]:
    """Cut a stream of sorted batches where one of ``keys`` changes; holds one run and one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for key in keys:
            column = batch.column(key)
            new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            if held:
                new[0] |= column[0].as_py() != held[-1].column(key)[-1].as_py()
        at = 0
        for cut in np.flatnonzero(new):
            if cut > at:
                held.append(batch.slice(at, cut - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)
