"""A Bloom filter over ids, of bounded size, to skip texts that no later step needs."""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the largest filter (8 MB). With more ids it lets more rows pass, never fewer.
MAX_BITS = 1 << 26
PROBES = 3


def _places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    from docwarden.llm.tokens import mix

    h = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x51ED27))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [(h + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(PROBES)]


def _set_words(bits: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = np.unique(np.concatenate(_places(batch.column(0).to_numpy(), bits)))
            mask = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array((at >> np.uint64(6)).view(np.int64)), pa.array(mask)], ["w", "m"]
            )

    return run


def id_filter(ids: DataFrame) -> Broadcast:
    """Broadcast the filter of a one-column table of longs without nulls."""
    spark = ids.sparkSession
    bits = 1 << 16
    n = ids.count()
    while bits < min(16 * n, MAX_BITS):
        bits *= 2
    found = (
        ids.mapInArrow(_set_words(bits), "w long, m long")
        .groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    )
    filled = np.zeros(bits // 64, np.uint64)
    filled[found.column("w").to_numpy()] = found.column("m").to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(filled)


def passes(filled: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids may be in the filter."""
    out = np.ones(len(ids), bool)
    for at in _places(ids, 64 * len(filled)):
        out &= (filled[(at >> np.uint64(6)).view(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out
