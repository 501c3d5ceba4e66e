"""Mix sources to target weights with a multivariate-hypergeometric splitting tree.

1. Every source gets a word quota: its share of the budget by weight, at most ``max_repeats``
   times its size, the excess shared again by weight.
2. A source's texts stand in an order permuted by hash, repeated as often as the quota asks; the
   quota is cut into at most ``BLOCKS`` blocks of equal words.
3. A binary tree over the output shards splits the block quotas: at every node blocks are drawn
   without replacement for the left half, all sources together, so each node's split is one
   multivariate-hypergeometric draw and the leaves add up to the quotas exactly.
4. A shard takes its number of blocks of each source from the permuted row, next to those of the
   shard before, so shards are disjoint; ``shuffle_key`` orders the draws inside a shard.

Only DataFrame functions. Texts are read once, for their word counts; everything after runs on
narrow rows. Running totals use hash buckets of bounded size, so a hot source is many tasks.
The table of sources (one row each) is the only thing held as one array.

Defined cases: a null or empty text has size 0 and takes 0; a null source is a source of its own,
after all others; sources without words have target 0; repeated rows are drawn like any others;
an empty table gives an empty table. The same rows and seed give the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docwarden.llm.rows import free_name, row_key
from docwarden.llm.storage import stored

#: Blocks a source's quota is cut into.
BLOCKS = 256
#: Rows of one bucket of the permuted order, about.
BUCKET_ROWS = 8192
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quotas(sizes: DataFrame, weights: tuple[int, ...], budget: float, max_repeats: int) -> DataFrame:
    """``source, rows, source_size, s, weight, target`` for one row per source.

    Sources whose cap is small for their weight fill up first. A source is capped if its cap is
    at most what the budget left by those before it gives; the rest share by weight.
    """
    every = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn(
        "s", F.row_number().over(every.orderBy(F.col("source").isNull(), "source")) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * float(max_repeats)
    by_ratio = every.orderBy(F.col("cap") / F.col("weight"), "s")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    given = ranked.withColumn("weight", weight).withColumn("cap", cap).withColumns({
        "whole": F.sum("source_size").over(every) * budget,
        "caps": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "left": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    capped = F.col("cap") * F.col("left") <= F.col("weight") * (F.col("whole") - F.col("caps"))
    marked = given.withColumn("capped", capped)
    free = lambda c: F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col(c))).over(every)
    taken = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(every)
    level = (F.col("whole") - taken) / free("weight")
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * level)
    return marked.select("source", "rows", "source_size", "s", "weight", target.alias("target"))


def _unit(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) / float(1 << 52)


def _split(quota: Column, node: Column, lo: Column, hi: Column, seed: int) -> Column:
    """Draw the left child's blocks from ``quota``, an array of (s, blocks), without replacement."""
    total = F.aggregate(quota, F.lit(0).cast("long"), lambda a, q: a + q.blocks)
    mid = F.floor((lo + hi) / 2)
    wanted = F.round(total * (mid - lo) / (hi - lo)).cast("long")

    def one_source(state: Column, q: Column) -> Column:
        # sequential sampling: a block goes left with the odds of what is still wanted and left
        drawn = F.aggregate(
            F.when(q.blocks > 0, F.sequence(F.lit(1).cast("long"), q.blocks)).otherwise(F.array().cast("array<long>")),
            F.struct(state.wanted.alias("wanted"), state.rest.alias("rest"), F.lit(0).cast("long").alias("got")),
            lambda a, k: _take(a, _unit(seed, node, q.s, k)),
        )
        return F.struct(
            drawn.wanted.alias("wanted"), drawn.rest.alias("rest"),
            F.concat(state.left, F.array(F.struct(q.s.alias("s"), drawn.got.alias("blocks")))).alias("left"))

    start = F.struct(
        wanted.alias("wanted"), total.alias("rest"),
        F.array().cast("array<struct<s:int,blocks:bigint>>").alias("left"))
    return F.aggregate(quota, start, one_source, lambda a: a.left)


def _take(a: Column, u: Column) -> Column:
    hit = (u * a.rest < a.wanted).cast("long")
    return F.struct(
        (a.wanted - hit).alias("wanted"), (a.rest - 1).alias("rest"), (a.got + hit).alias("got"))


def shard_quotas(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """``s, firsts``: each source's first block number in every shard, from the splitting tree."""
    quota = F.array_sort(F.collect_list(F.struct("s", F.col("n_blocks").alias("blocks"))))
    nodes = blocks.agg(quota.alias("quota")).select(
        F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "quota")
    while shards > 1:
        node = F.concat_ws("-", "lo", "hi")
        split = nodes.withColumn(
            "left", F.when(F.col("hi") - F.col("lo") > 1,
                           _split(F.col("quota"), node, F.col("lo"), F.col("hi"), seed)))
        right = F.zip_with("quota", "left", lambda q, x: F.struct(q.s.alias("s"), (q.blocks - x.blocks).alias("blocks")))
        mid = F.floor((F.col("lo") + F.col("hi")) / 2)
        children = F.when(F.col("left").isNull(), F.array(F.struct("lo", "hi", "quota"))).otherwise(F.array(
            F.struct("lo", mid.alias("hi"), F.col("left").alias("quota")),
            F.struct(mid.alias("lo"), "hi", right.alias("quota"))))
        nodes = split.select(F.explode(children).alias("c")).select("c.*")
        shards = (shards + 1) // 2
    flat = nodes.select(F.col("lo").alias("shard"), F.explode("quota").alias("q"))
    before = Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    firsts = flat.select(F.col("q.s").alias("s"), "shard", F.col("q.blocks").alias("b")).withColumn(
        "first", F.coalesce(F.sum("b").over(before), F.lit(0)))
    return firsts.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("shard", "first"))).alias("firsts"))


def mix(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, max_repeats: int = 2,
    shards: int = 8, whole: bool = False, seed: int = 11,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, source, source_size, target, taken, draws``.

    ``draws`` is an array of (pass, words, block, shard, shuffle_key), one entry each time the
    text is taken. Without ``whole`` the last text of a quota gives only the words still wanted;
    with it, texts are taken whole when at least half of them is wanted.
    """
    narrow = stored(docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"),
        n_words(F.col(f"`{text}`").cast("string")).alias("size"),
        F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`"), F.col(f"`{text}`").cast("string"))
        .bitwiseAND(F.lit(2**63 - 1)).alias("h")))
    sizes = narrow.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    planned = quotas(sizes, weights, budget, max_repeats).withColumn("quota", F.round("target").cast("long"))
    block_words = F.greatest(F.lit(1), F.ceil(F.col("quota") / BLOCKS)).cast("long")
    planned = planned.withColumn("block_words", block_words).withColumn(
        "n_blocks", F.ceil(F.col("quota") / F.col("block_words")).cast("long"))
    planned = stored(planned)
    tree = shard_quotas(planned, shards, seed)
    planned = stored(planned.join(tree, "s", "left"))

    known = planned.select(F.col("source").alias("source_"), F.col("rows").alias("rows_"), "s")
    bucket = F.floor(F.col("h") / float(2**63) * F.ceil(F.col("rows_") / BUCKET_ROWS))
    placed = narrow.join(known, F.col("source").eqNullSafe(F.col("source_"))).select(
        "doc_id", "size", "h", "s", bucket.alias("bucket"))
    totals = placed.groupBy("s", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("s", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("s", "bucket").orderBy("h", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = placed.withColumn("offset", F.coalesce(F.sum("size").over(within), F.lit(0)))
    offsets = offsets.join(bases, ["s", "bucket"]).withColumn("offset", F.col("offset") + F.col("base"))
    info = planned.select("s", "source", "source_size", "target", "quota", "block_words", "firsts")
    joined = offsets.join(info, "s")
    draws = F.filter(
        F.array(*[_draw(k, whole, seed) for k in range(max_repeats + 1)]), lambda d: d.words > 0)
    drawn = joined.withColumn("draws", draws)
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d.words)
    return drawn.select("doc_id", "size", "source", "source_size", "target", taken.alias("taken"), "draws")


def _draw(k: int, whole: bool, seed: int) -> Column:
    """What the k-th pass over the permuted source takes of a text."""
    start = F.col("offset") + k * F.col("source_size")
    room = F.col("quota") - start
    if whole:
        words = F.when(room * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    else:
        words = F.least(F.col("size"), F.greatest(room, F.lit(0)))
    block = F.floor(start / F.col("block_words"))
    shard = F.size(F.filter("firsts", lambda f: f.first <= block)) - 1
    return F.struct(
        F.lit(k).alias("pass"), words.cast("long").alias("words"), block.cast("long").alias("block"),
        shard.cast("int").alias("shard"), F.xxhash64(F.lit(seed + 1), "h", F.lit(k)).alias("shuffle_key"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The columns of ``docs``, each row as often as the mix takes it whole.

    Rows are told apart by a hash of all their columns, not by id. Equal rows are interchangeable:
    one of them is given as often as all of them are taken.
    """
    name = free_name(docs.columns, "key")
    named = docs.withColumn(name, row_key(docs))
    drawn = mix(named, doc_id=name, whole=True, **options)
    again, times = (free_name([*named.columns, "again"], x) for x in ("same", "times"))
    taken = stored(drawn.groupBy(F.col("doc_id").alias(again)).agg(
        F.sum(F.size("draws")).cast("int").alias(times), F.count("*").alias("rows")).where(F.col(times) > 0))
    columns = [F.col(f"`{c}`") for c in docs.columns]

    def given(rows: DataFrame, wanted: DataFrame) -> DataFrame:
        repeats = F.array_repeat(F.lit(0), F.col(times))
        return rows.join(wanted.select(again, times), F.col(name) == F.col(again)).select(
            *columns, F.explode(repeats).alias(name)).drop(name)

    several = taken.where("rows > 1")
    if several.isEmpty():
        return given(named, taken)
    equal = named.join(several.select(again), F.col(name) == F.col(again), "left_semi").dropDuplicates([name])
    return given(named, taken.where("rows = 1")).unionByName(given(equal, several))
