"""A table that takes every key once, with an index that is asked before rows are read.

Rows live in *segments*: one per batch that brought new keys, or per compaction. A segment is cut
into parts by the upper bits of the key hash, one file of about ``PART_ROWS`` rows each, and every
part has a Bloom filter of its keys. Commit records list the segments that count; the newest one is
the table.

* A batch is written to a staging folder once. Its keys ask the filters of the parts they fall into,
  and only parts whose filter admits one of them are opened to see whether the key is really there.
* A commit is one small file that appears whole. A batch that failed half-way left folders that no
  commit names, and its retry writes them again; a batch whose commit is there is not done twice.
* Segments of one size class are merged when ``MERGE`` of them have gathered, so the table keeps a
  logarithmic number of segments and no crowd of small files. Merged segments stay on disk until
  the next compaction, for readers that still use them.

One stream writes a table; a second writer finds the record of its version taken and fails.
"""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one part.
PART_ROWS = 250_000
#: Bits of one page of a filter, as built by ``bitmap_construct_agg``, and keys it is made for: with
#: 16 bits a key and three probes, about one foreign key in 200 is admitted.
PAGE_BITS = 32_768
PAGE_KEYS = PAGE_BITS // 16
PROBES = 3
#: Segments of one size class that are merged.
MERGE = 8


def _path(spark: SparkSession, text: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(text)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _exists(spark: SparkSession, text: str) -> bool:
    files, path = _path(spark, text)
    return files.exists(path)


def _delete(spark: SparkSession, text: str) -> None:
    files, path = _path(spark, text)
    files.delete(path, True)


def committed(spark: SparkSession, target: str) -> dict:
    """The newest commit record: version, segments, expired segments, last batch of each run."""
    files, folder = _path(spark, f"{target}/commits")
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    names = sorted(n for n in names if n.endswith(".json"))
    if not names:
        return {"version": 0, "segments": [], "expired": [], "batches": {}}
    stream = files.open(_path(spark, f"{target}/commits/{names[-1]}")[1])
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _commit(spark: SparkSession, target: str, record: dict) -> None:
    """Make ``record`` the table: written aside, then renamed to the name of its version."""
    name = f"{target}/commits/{record['version']:012d}"
    files, path = _path(spark, f"{name}.json")
    if files.exists(path):
        raise RuntimeError(f"{target} has another writer: version {record['version']} is taken")
    aside = _path(spark, f"{name}.new")[1]
    stream = files.create(aside, True)
    stream.write(bytearray(json.dumps(record).encode()))
    stream.close()
    if not files.rename(aside, path):
        raise RuntimeError(f"{target} has another writer: version {record['version']} is taken")


def _folder(target: str, kind: str, segment: str, part: int | None = None) -> str:
    return f"{target}/{kind}/segment={segment}" + ("" if part is None else f"/part={part}")


def _read(spark: SparkSession, target: str, kind: str, folders: list[str]) -> DataFrame:
    return spark.read.option("basePath", f"{target}/{kind}").parquet(*folders)


def _bits_for(n: int) -> int:
    return max(0, math.ceil(math.log2(n))) if n > 1 else 0


def _top(hash_: Column, bits: int, skip: int = 0) -> Column:
    """``bits`` bits of a hash after the upper ``skip`` ones."""
    if not bits:
        return F.lit(0)
    return F.shiftrightunsigned(F.shiftleft(hash_, skip), 64 - bits).cast("int")


def _probes(hash_: Column) -> Column:
    """Places of a key in its page, from the lower bits of its hash."""
    return F.array(*[
        F.shiftrightunsigned(hash_, 15 * k).bitwiseAND(F.lit(PAGE_BITS - 1)) for k in range(PROBES)
    ])


def _bit(bits: str, place: Column) -> Column:
    byte = F.conv(F.hex(F.substr(F.col(bits), (place / 8).cast("int") + 1, F.lit(1))), 16, 10)
    return F.floor(byte.cast("int") / F.pow(F.lit(2), place % 8)) % 2 == 1


def _write_segment(spark: SparkSession, target: str, name: str, rows: DataFrame, n: int) -> dict:
    """Write a segment's rows (with ``_hash``) and filters; both replace what a failed try left."""
    part_bits = _bits_for(-(-n // PART_ROWS))
    page_bits = _bits_for(-(-min(n, PART_ROWS) // PAGE_KEYS))
    placed = rows.withColumn("part", _top(F.col("_hash"), part_bits))
    placed.repartition("part").write.mode("overwrite").partitionBy("part").parquet(_folder(target, "data", name))
    keys = spark.read.parquet(_folder(target, "data", name)).select("part", "_hash")
    pages = keys.select(
        "part", _top(F.col("_hash"), page_bits, part_bits).alias("page"),
        F.explode(_probes(F.col("_hash"))).alias("place"),
    ).groupBy("part", "page").agg(F.bitmap_construct_agg("place").alias("bits"))
    pages.repartition("part").write.mode("overwrite").partitionBy("part").parquet(_folder(target, "index", name))
    return {"name": name, "rows": n, "part_bits": part_bits, "page_bits": page_bits}


def _admitted(spark: SparkSession, target: str, keys: DataFrame, segments: list[dict]) -> list[tuple[str, int]]:
    """(segment, part) whose filter admits one of ``keys`` (column ``_hash``)."""
    most = max(s["part_bits"] for s in segments)
    places = [r.top for r in keys.select(_top(F.col("_hash"), most).alias("top")).distinct().collect()]
    found: set[tuple[str, int]] = set()
    for s in segments:
        touched = sorted({top >> (most - s["part_bits"]) for top in places})
        folders = [_folder(target, "index", s["name"], p) for p in touched]
        # hashes fill a segment's parts evenly, but a small one need not have every part
        folders = [f for f in folders if s["part_bits"] == 0 or _exists(spark, f)]
        if not folders:
            continue
        filters = _read(spark, target, "index", folders)
        asked = keys.select(
            _top(F.col("_hash"), s["part_bits"]).alias("part"),
            _top(F.col("_hash"), s["page_bits"], s["part_bits"]).alias("page"),
            _probes(F.col("_hash")).alias("places"))
        hit = asked.join(filters, ["part", "page"]).where(F.forall("places", lambda p: _bit("bits", p)))
        found |= {(s["name"], r.part) for r in hit.select("part").distinct().collect()}
    return sorted(found)


def _size_class(segment: dict) -> int:
    return int(math.log(max(segment["rows"], 1), MERGE))


def compact(spark: SparkSession, target: str, merge: int = MERGE) -> bool:
    """Merge the segments of the smallest size class that has ``merge`` of them."""
    now = committed(spark, target)
    classes: dict[int, list[dict]] = {}
    for s in now["segments"]:
        classes.setdefault(_size_class(s), []).append(s)
    ripe = [c for c in sorted(classes) if len(classes[c]) >= merge]
    if not ripe:
        return False
    for name in now["expired"]:
        _delete(spark, _folder(target, "data", name))
        _delete(spark, _folder(target, "index", name))
    old = classes[ripe[0]]
    rows = _segments(spark, target, [s["name"] for s in old])
    version = now["version"] + 1
    merged = _write_segment(spark, target, f"merged-{version:012d}", rows, sum(s["rows"] for s in old))
    names = {s["name"] for s in old}
    _commit(spark, target, {
        "version": version, "segments": [s for s in now["segments"] if s["name"] not in names] + [merged],
        "expired": sorted(names), "batches": now["batches"]})
    return True


def _segments(spark: SparkSession, target: str, names: list[str]) -> DataFrame:
    return _read(spark, target, "data", [_folder(target, "data", n) for n in names]).drop("segment", "part")


def read_keyed(spark: SparkSession, target: str) -> DataFrame | None:
    """The committed rows; None before the first commit that has rows."""
    names = [s["name"] for s in committed(spark, target)["segments"]]
    return _segments(spark, target, names).drop("_hash") if names else None


def first_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row per key by ``order``; ties go by a digest of the row, so reruns agree.

    Columns may be of any type, maps too, since only ``order`` and the digest are compared."""
    others = [c for c in rows.columns if c != key]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("_none"))
    by = [F.col(f"`{order}`")] if order in others else []
    first = rows.groupBy(key).agg(F.min_by(row, F.struct(*by, F.xxhash64(F.to_json(row)))).alias("_row"))
    return first.select(key, *[F.col("_row")[c].alias(c) for c in others])


def append_new(
    batch: DataFrame, target: str, batch_id: int = 0, run: str = "", key: str = "analysis_id",
    order: str = "created_at", merge: int = MERGE,
) -> dict:
    """Append rows whose key the table does not have, the first row per key by ``order``.

    Returns how many rows were appended and which parts had to be opened. Batches of one ``run``
    have rising numbers; one that is committed already is left alone.
    """
    spark = batch.sparkSession
    run = hashlib.sha256(run.encode()).hexdigest()[:12]
    now = committed(spark, target)
    if now["batches"].get(run, -1) >= batch_id:
        return {"appended": 0, "opened": []}
    name = f"batch-{run}-{batch_id:012d}"
    staging = f"{target}/staging/{name}"
    first_rows(batch, key, order).withColumn("_hash", F.xxhash64(key)).write.mode("overwrite").parquet(staging)
    fresh = spark.read.parquet(staging)
    opened = _admitted(spark, target, fresh.select("_hash"), now["segments"]) if now["segments"] else []
    if opened:
        # the hash is compared first, the key decides
        parts = _read(spark, target, "data", [_folder(target, "data", *place) for place in opened])
        known = parts.select(key, "_hash").join(fresh.select("_hash").distinct(), "_hash", "left_semi")
        fresh = fresh.join(known.select(key), key, "left_anti")
    n = fresh.count()
    added = [_write_segment(spark, target, name, fresh, n)] if n else []
    _commit(spark, target, {
        "version": now["version"] + 1, "segments": now["segments"] + added, "expired": now["expired"],
        "batches": now["batches"] | {run: batch_id}})
    _delete(spark, staging)
    compact(spark, target, merge)
    return {"appended": n, "opened": opened}
