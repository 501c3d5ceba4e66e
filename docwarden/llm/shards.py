"""Sharding by a K-d tree over document metadata.

All documents start in one cell. A cell that stands for more than one shard is split along its
widest metadata dimension (its range divided by the range over all documents) at the weighted
median, bytes being the weights, until every cell is one shard. Cuts are exact weighted
quantiles, found by radix descent: three grouped sums over the digits of a 63-bit key, no sort
and nothing but one row per cell sent to the driver.

A text dimension is placed by its rank among the distinct values, in code-point order, however long
a common beginning they have. Units of the split are groups of equal texts, so copies stay together;
only a group of more than ``group_share`` of a shard's bytes, with which shards could not be of near
equal size, is dealt into parts by id and may span shards.

Everything after one pass over the texts runs on narrow rows; slots are numbered in hash buckets
of bounded size.

Defined cases: a null text has no bytes, size 1 and checksum 0; null metadata sort first; ties on
every dimension are ordered by the text's hash; repeated rows get slots of their own; an empty
table gives an empty table; fewer units than shards leave shards empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docwarden.llm.ranks import ranked
from docwarden.llm.storage import stored

#: Share of a shard's bytes up to which a group of copies stays whole.
GROUP_SHARE = 0.1
#: Rows numbered by one task at a time, about.
BUCKET_ROWS = 16_384
#: Bits of the three digits of a unit's key.
DIGITS = (21, 21, 21)


def number_place(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(-1.0))


def _placed_texts(narrow: DataFrame, name: str) -> DataFrame:
    """``name``, a text, replaced by the rank of its value; null comes first."""
    values = narrow.groupBy(F.col(name).alias("value")).agg(F.lit("").alias("one"))
    ranks = ranked(stored(values), "one", ["value"]).select("value", F.col("idx").cast("double").alias("rank"))
    return narrow.join(ranks, F.col(name).eqNullSafe(F.col("value"))).withColumn(name, F.col("rank")).drop("value", "rank")


def _units(narrow: DataFrame, dims: list[str], part_bytes: float) -> DataFrame:
    """Groups of equal texts with their bytes and places, large groups in parts."""
    group = narrow.groupBy("h", "crc", "size").agg(
        F.count("*").alias("rows"), *[F.min(d).alias(d) for d in dims])
    parts = F.greatest(F.lit(1), F.ceil(F.col("rows") * F.col("size") / part_bytes)).cast("int")
    grouped = group.withColumn("parts", parts)
    small = grouped.where("parts = 1").select(
        "h", "crc", "size", "parts", F.lit(0).alias("part"), (F.col("rows") * F.col("size")).alias("w"), *dims)
    large = grouped.where("parts > 1").select("h", "crc", "size", "parts", *dims)
    dealt = narrow.select("h", "crc", "size", "spread").join(large, ["h", "crc", "size"])
    dealt = dealt.withColumn("part", F.pmod("spread", F.col("parts")).cast("int")).groupBy(
        "h", "crc", "size", "parts", "part", *dims).agg(F.sum("size").alias("w"))
    return small.unionByName(dealt.select(*small.columns))


def _cuts(units: DataFrame, goals: DataFrame) -> dict[int, tuple[int, bool]]:
    """Per cell, the key at its weighted quantile and whether that key goes left.

    ``units`` has cell, key and w; ``goals`` has cell and the weight wanted on the left.
    """
    at = goals.withColumns({"lead": F.lit(0).cast("long"), "below": F.lit(0).cast("long")})
    shift = sum(DIGITS)
    for bits in DIGITS:
        shift -= bits
        prefix = F.expr(f"key div {1 << (shift + bits)}") if shift + bits < 63 else F.lit(0).cast("long")
        digit = F.expr(f"(key div {1 << shift}) % {1 << bits}").cast("long")
        # one row per cell, made on the driver: no more rows than there are shards
        sums = units.withColumns({"lead_": prefix, "digit": digit}).join(
            F.broadcast(at), F.col("cell") == F.col("g")).where("lead_ = lead").groupBy("g", "goal", "lead", "below", "digit").agg(F.sum("w").alias("w"))
        upto = Window.partitionBy("g").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        before = F.col("below") + F.coalesce(F.sum("w").over(upto), F.lit(0))
        # the first digit always qualifies: goals are above 0 and above what lies below the prefix
        found = sums.withColumn("before", before).where("before < goal").groupBy("g", "goal", "lead").agg(F.max(F.struct("digit", "before", "w")).alias("m"))
        rows = found.collect()  # one row per cell that is split
        at = units.sparkSession.createDataFrame(
            [(r.g, r.goal, r.lead * (1 << bits) + r.m.digit, r.m.before) for r in rows],
            "g long, goal double, lead long, below long")
    return {r.g: (r.lead * (1 << DIGITS[-1]) + r.m.digit, r.m.before + r.m.w - r.goal <= r.goal - r.m.before)
            for r in rows}


def kd_shards(
    docs: DataFrame, dims: dict[str, Column], *, shards: int | None = None,
    target_bytes: int | None = None, doc_id: str = "doc_id", text: str = "text",
    group_share: float = GROUP_SHARE,
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row of ``docs``.

    ``dims`` are metadata columns, numbers or texts. ``shards`` is the number of leaves, or follows from
    ``target_bytes``.
    """
    body = F.col(f"`{text}`").cast("string")
    raw = F.coalesce(F.encode(body, "UTF-8"), F.lit(b""))
    key = F.col(f"`{doc_id}`")
    kinds = docs.select(*[c.alias(name) for name, c in dims.items()]).schema
    texts = {f.name for f in kinds if f.dataType.simpleString() == "string"}
    narrow = stored(docs.select(
        key.alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("crc"), F.xxhash64(raw).alias("h"), F.xxhash64(key, raw).alias("spread"),
        *[(c if name in texts else F.coalesce(c.cast("double"), F.lit(-1.0))).alias(f"d_{name}") for name, c in dims.items()]))
    for name in sorted(texts):
        narrow = _placed_texts(narrow, f"d_{name}")
    narrow = stored(narrow) if texts else narrow
    names = [f"d_{name}" for name in dims]
    whole = narrow.agg(F.sum("size").alias("w"), F.count("*").alias("rows"), *_ranges(names)).first()
    total = whole.w or 0
    if shards is None:
        shards = max(1, -(-total // target_bytes))
    units = _units(narrow, names, max(1.0, total / shards * group_share))
    celled = stored(units.withColumn("cell", F.lit(0).cast("long")))
    cells = {0: shards}  # first shard of a cell, and how many shards it stands for
    while any(n > 1 for n in cells.values()):
        celled, cells = _split_cells(celled, cells, names, whole)
    placed = celled.select("h", "crc", "size", "parts", "part", F.col("cell").alias("shard"))
    return _with_slots(narrow, stored(placed), whole.rows)


def _ranges(names: list[str]) -> list[Column]:
    return [f(n).alias(f"{k}{n}") for n in names for k, f in (("lo_", F.min), ("hi_", F.max))]


def _split_cells(celled: DataFrame, cells: dict[int, int], names: list[str], whole):
    """Split every cell of more than one shard once."""
    spark = celled.sparkSession
    stats = celled.groupBy("cell").agg(F.sum("w").alias("w"), *_ranges(names)).collect()
    plan, goals = [], []
    known = {r.cell for r in stats}
    cells = {cell: n if cell in known else 1 for cell, n in cells.items()}  # without rows: no split
    for r in stats:
        n = cells[r.cell]
        if n == 1:
            continue

        def width(name: str, r=r) -> float:
            full = whole[f"hi_{name}"] - whole[f"lo_{name}"]
            return (r[f"hi_{name}"] - r[f"lo_{name}"]) / full if full else 0.0

        dim = max(range(len(names)), key=lambda i: (width(names[i]), -i))
        lo, hi = r[f"lo_{names[dim]}"], r[f"hi_{names[dim]}"]
        plan.append((r.cell, dim, float(lo), float(hi - lo)))
        goals.append((r.cell, r.w * (n // 2) / n))
    if not plan:
        return celled, cells
    table = spark.createDataFrame(plan, "cell long, dim int, lo double, span double")
    place = F.element_at(F.array(*names), F.col("dim") + 1)
    scaled = F.when(F.col("span") > 0, F.floor((place - F.col("lo")) / F.col("span") * (2**31 - 1))).otherwise(0)
    # 31 bits of the place on the widest dimension, then 32 bits of the text's hash
    tie = F.shiftrightunsigned(F.xxhash64("h", "part"), 32)
    keyed = celled.join(F.broadcast(table), "cell", "left").withColumn(
        "key", scaled.cast("long") * F.lit(2**32) + tie).drop("dim", "lo", "span")
    cuts = _cuts(keyed.where("key IS NOT NULL"), spark.createDataFrame(goals, "g long, goal double"))
    rows = [(cell, at, left, cells[cell] // 2) for cell, (at, left) in cuts.items()]
    cut = spark.createDataFrame(rows, "cell long, at long, at_left boolean, left_shards long")
    goes_right = (F.col("key") > F.col("at")) | ((F.col("key") == F.col("at")) & ~F.col("at_left"))
    moved = keyed.join(F.broadcast(cut), "cell", "left").withColumn(
        "cell", F.col("cell") + F.when(goes_right, F.col("left_shards")).otherwise(0))
    split = {}
    for cell, n in cells.items():
        left = n // 2 if n > 1 else n
        split[cell] = left
        if n > 1:
            split[cell + left] = n - left
    return moved.drop("key", "at", "at_left", "left_shards"), split


def _with_slots(narrow: DataFrame, placed: DataFrame, rows: int) -> DataFrame:
    """Join rows to their unit's shard and number them without gaps inside each shard."""
    whole = placed.where("parts = 1").select("h", "crc", "size", "shard")
    dealt = placed.where("parts > 1")
    large = dealt.select("h", "crc", "size", "parts").distinct()
    base = narrow.select("doc_id", "size", "crc", "h", "spread")
    one = base.join(whole, ["h", "crc", "size"])
    parted = base.join(large, ["h", "crc", "size"]).withColumn(
        "part", F.pmod("spread", F.col("parts")).cast("int"))
    many = parted.join(dealt, ["h", "crc", "size", "parts", "part"])
    cols = ["doc_id", "size", F.col("crc").alias("text_crc32"), "spread", F.col("shard").cast("int").alias("shard")]
    buckets = max(1, -(-rows // BUCKET_ROWS))
    found = stored(one.select(*cols).unionByName(many.select(*cols)).withColumn(
        "bucket", F.pmod("spread", F.lit(buckets)).cast("int")))
    sizes = found.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("spread", "doc_id"))
    return found.withColumn("slot", inside).join(bases, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("slot") - 1 + F.col("base")).alias("slot"))
