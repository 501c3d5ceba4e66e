"""The table that takes every key once: index, commits, compaction and retries."""

import os

import pytest
from pyspark.sql import functions as F

from docwarden.streaming import keyed


def rows(spark, low, high, more=None):
    found = spark.range(low, high).select(
        F.concat(F.lit("a"), F.col("id")).alias("analysis_id"), F.timestamp_seconds(F.col("id")).alias("created_at"),
        F.create_map(F.lit("k"), F.col("id")).alias("counts"))
    return found if more is None else found.unionByName(rows(spark, *more))


def ids(spark, target):
    return sorted(int(r.analysis_id[1:]) for r in keyed.read_keyed(spark, target).select("analysis_id").collect())


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(keyed, "PART_ROWS", 1000)


def test_only_admitted_parts_are_opened(spark, tmp_path, small_parts, monkeypatch):
    target = str(tmp_path / "t")
    keyed.append_new(rows(spark, 0, 20_000), target, 0, "r")
    assert len(os.listdir(keyed._folder(target, "data", keyed.committed(spark, target)["segments"][0]["name"]))) >= 20
    opened = []
    reader = type(spark.read)
    plain = reader.parquet

    def watched(self, *paths, **options):
        opened.extend(p for p in paths if "/data/" in p and "part=" in p)
        return plain(self, *paths, **options)

    monkeypatch.setattr(reader, "parquet", watched)
    # 1,000 new keys: hardly a part is admitted
    report = keyed.append_new(rows(spark, 50_000, 51_000), target, 1, "r")
    assert report["appended"] == 1000 and len(report["opened"]) < 20
    assert len(opened) == len(report["opened"])
    opened.clear()
    # known keys: exactly the parts that hold them, and those a false hit adds
    known = keyed.append_new(rows(spark, 7, 10), target, 2, "r")
    first = keyed.committed(spark, target)["segments"][0]
    hold = {r.part for r in plain(spark.read, keyed._folder(target, "data", first["name"])).where(
        F.col("analysis_id").isin("a7", "a8", "a9")).select("part").distinct().collect()}
    assert known["appended"] == 0 and hold <= {p for s, p in known["opened"] if s == first["name"]}
    assert len(opened) == len(known["opened"]) <= 4
    assert ids(spark, target) == [*range(20_000), *range(50_000, 51_000)]


def test_filters_admit_every_key_and_few_others(spark, tmp_path):
    target = str(tmp_path / "t")
    keyed.append_new(rows(spark, 0, 5000), target)
    segment = keyed.committed(spark, target)["segments"][0]
    filters = spark.read.parquet(keyed._folder(target, "index", segment["name"]))

    def admitted(low, high):
        hashed = rows(spark, low, high).select(F.xxhash64("analysis_id").alias("_hash"))
        asked = hashed.select(
            keyed._top(F.col("_hash"), segment["page_bits"], segment["part_bits"]).alias("page"),
            keyed._probes(F.col("_hash")).alias("places"))
        return asked.join(filters, "page").where(F.forall("places", lambda p: keyed._bit("bits", p))).count()

    assert admitted(0, 5000) == 5000
    assert admitted(10_000, 20_000) < 200


def test_first_row_wins_and_maps_are_kept(spark, tmp_path):
    target = str(tmp_path / "t")
    twice = rows(spark, 0, 3).unionByName(rows(spark, 0, 3).withColumn("created_at", F.timestamp_seconds(F.lit(-5))))
    keyed.append_new(twice, target)
    got = keyed.read_keyed(spark, target)
    assert got.columns == ["analysis_id", "created_at", "counts"]
    assert {r.created_at.timestamp() for r in got.collect()} == {-5.0}
    assert {r.counts["k"] for r in got.collect()} == {0, 1, 2}


def test_retries_do_nothing_twice(spark, tmp_path):
    target = str(tmp_path / "t")
    for batch_id, (low, high) in [(0, (0, 10)), (0, (0, 10)), (1, (5, 15)), (1, (5, 15)), (0, (0, 10))]:
        keyed.append_new(rows(spark, low, high), target, batch_id, "r")
    assert ids(spark, target) == list(range(15))
    # another run replays everything
    assert keyed.append_new(rows(spark, 0, 15), target, 0, "other")["appended"] == 0
    assert keyed.append_new(rows(spark, 0, 0), target, 1, "other")["appended"] == 0


def test_a_batch_that_failed_before_its_commit(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "t")
    keyed.append_new(rows(spark, 0, 10), target, 0, "r")
    commit = keyed._commit

    def lost(*_):
        raise OSError("driver lost")

    monkeypatch.setattr(keyed, "_commit", lost)
    with pytest.raises(OSError):
        keyed.append_new(rows(spark, 5, 20), target, 1, "r")
    assert ids(spark, target) == list(range(10))
    monkeypatch.setattr(keyed, "_commit", commit)
    assert keyed.append_new(rows(spark, 5, 20), target, 1, "r")["appended"] == 10
    assert ids(spark, target) == list(range(20))


def test_compaction_keeps_all_rows_and_few_segments(spark, tmp_path):
    target = str(tmp_path / "t")
    for i in range(9):
        keyed.append_new(rows(spark, 10 * i, 10 * i + 12), target, i, "r", merge=3)
    now = keyed.committed(spark, target)
    assert len(now["segments"]) <= 4 and any(s["name"].startswith("merged") for s in now["segments"])
    assert ids(spark, target) == list(range(92))
    # merged segments answer for their keys
    assert keyed.append_new(rows(spark, 0, 92), target, 9, "r", merge=3)["appended"] == 0
    # replaced folders stay for readers of the version before and go with the next compaction
    kept = {s["name"] for s in now["segments"]} | set(now["expired"])
    assert set(os.listdir(f"{target}/data")) == {f"segment={name}" for name in kept}


@pytest.mark.parametrize("at", ["_write_segment", "_commit"])
def test_retry_in_mid_compaction_loses_nothing(spark, tmp_path, monkeypatch, at):
    target = str(tmp_path / "t")
    for i in range(3):
        keyed.append_new(rows(spark, 10 * i, 10 * i + 10), target, i, "r", merge=99)
    before = keyed.committed(spark, target)
    plain = getattr(keyed, at)

    def stopped(*args):
        if at == "_write_segment":
            plain(*args)
        raise OSError("driver lost")

    monkeypatch.setattr(keyed, at, stopped)
    with pytest.raises(OSError):
        keyed.compact(spark, target, merge=3)
    monkeypatch.setattr(keyed, at, plain)
    assert keyed.committed(spark, target) == before and ids(spark, target) == list(range(30))
    assert keyed.compact(spark, target, merge=3) and not keyed.compact(spark, target, merge=3)
    assert ids(spark, target) == list(range(30))
    assert keyed.append_new(rows(spark, 0, 31), target, 3, "r")["appended"] == 1


def test_second_writer_is_refused(spark, tmp_path):
    target = str(tmp_path / "t")
    keyed.append_new(rows(spark, 0, 3), target)
    with pytest.raises(RuntimeError, match="another writer"):
        keyed._commit(spark, target, keyed.committed(spark, target))
