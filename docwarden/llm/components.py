"""Connected components of a link table, by star contraction in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwarden.llm.storage import stored

#: More rounds than any link table needs that fits a cluster; the number of rounds is logarithmic.
MAX_ROUNDS = 60


def smallest_reachable(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` for every id with a link; ``component`` is its smallest reachable id.

    Each round lets every node point its larger neighbours, then its smaller ones, at the
    smallest id seen. Only sums and minima are grouped, so a node with very many links is
    combined before the shuffle. Self links and nulls count as no link.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = stored(
        pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    total = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        # every larger neighbour of u, and u itself, is pointed at the smallest one
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == total:
            break
        total = now
    else:
        raise RuntimeError("components did not settle")
    found = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    roots = found.select(F.col("component").alias("id"), "component").distinct()
    return found.unionByName(roots)
