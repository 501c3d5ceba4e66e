"""Fact tables: appends by run, dated reads, columns added over time, payloads."""

import datetime

import pytest
from pyspark.sql import functions as F

from docwarden.operators import history
from docwarden.sources import facts, sinks

SCHEMA = "id bigint, created_at timestamp, note string"


def dated(spark, low, high):
    return spark.range(low, high).select(
        "id", F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 86400).alias("created_at"),
        F.concat(F.lit("n"), F.col("id")).alias("note"))


def ids(rows):
    return sorted(r.id for r in rows.collect())


def test_a_retried_run_leaves_one_set_of_rows(spark, tmp_path):
    path = str(tmp_path / "f")
    for _ in range(3):
        facts.append_facts(dated(spark, 0, 5), path, "a")
    facts.append_facts(dated(spark, 3, 7), path, "b")
    assert ids(facts.read_facts(spark, path, SCHEMA)) == [0, 1, 2, 3, 3, 4, 4, 5, 6]
    for _ in range(2):
        sinks.write_jsonl(dated(spark, 0, 2), str(tmp_path / "log"), "a")
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_reads_of_dates_skip_folders(spark, tmp_path):
    path = str(tmp_path / "f")
    facts.append_facts(dated(spark, 0, 40), path, "a")
    some = facts.read_facts(spark, path, SCHEMA, since=datetime.date(2024, 1, 5), until="2024-01-07")
    assert ids(some) == [4, 5, 6]
    plan = some._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):].split("PushedFilters")[0]
    assert "created_date" in filters and ">=" in filters and "<=" in filters
    assert len(some.inputFiles()) == 40 and some.rdd.getNumPartitions() <= 3


def test_columns_added_later_have_defaults_and_written_nulls_stay(spark, tmp_path):
    path = str(tmp_path / "f")
    facts.append_facts(dated(spark, 0, 2).drop("note"), path, "old")
    facts.append_facts(dated(spark, 2, 4).withColumns({
        "note": F.when(F.col("id") == 2, "x"), "more": F.lit(1.5)}), path, "new")
    rows = facts.read_facts(spark, path, SCHEMA + ", level int", {"note": "'none'", "level": "7"})
    assert rows.columns[:4] == ["id", "created_at", "note", "level"] and "more" in rows.columns
    assert {r.id: (r.note, r.level, r.more) for r in rows.collect()} == {
        0: ("none", 7, None), 1: ("none", 7, None), 2: ("x", 7, 1.5), 3: (None, 7, 1.5)}
    with pytest.raises(ValueError, match="nothing"):
        facts.read_facts(spark, path, SCHEMA, {"nothing": "1"})


def test_changed_types_are_named(spark, tmp_path):
    path = str(tmp_path / "f")
    facts.append_facts(dated(spark, 0, 2), path, "a")
    with pytest.raises(facts.ChangedColumn, match="column note is string in the files, int was asked for"):
        facts.read_facts(spark, path, "id bigint, note int")
    narrow = dated(spark, 0, 2).withColumn("id", F.col("id").cast("int"))
    facts.append_facts(narrow, str(tmp_path / "g"), "a")
    assert ids(facts.read_facts(spark, str(tmp_path / "g"), SCHEMA)) == [0, 1]  # int read as bigint
    facts.append_facts(dated(spark, 5, 6).withColumn("note", F.lit(3)), path, "b")
    with pytest.raises(facts.ChangedColumn, match="column note is"):
        facts.read_facts(spark, path, SCHEMA)


def test_payloads_come_back_typed(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, 3, 120, "ocr", None, None), (2, None, 7, None, 5, 2), (3, None, None, None, None, None)],
        "id bigint, pages int, characters int, extraction_method string, rows int, columns int")
    kept = rows.select("id", history.metadata_payload(rows).alias("metadata"),
                       F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    facts.append_facts(kept, str(tmp_path / "f"), "a")
    back = facts.read_facts(spark, str(tmp_path / "f"), kept.schema)
    got = history.with_metadata(back).orderBy("id")
    assert [tuple(r[c] for c in ("pages", "characters", "extraction_method", "rows", "columns", "ocr_status"))
            for r in got.collect()] == [
        (3, 120, "ocr", None, None, None), (None, 7, None, 5, 2, None), (None,) * 6]
    # a payload from elsewhere may hold another type: null, not a failed job
    odd = spark.sql("""SELECT parse_json('{"pages":"many","rows":4}') AS metadata""")
    assert tuple(history.with_metadata(odd, "pages", "rows").first())[1:] == (None, 4)


def test_search_finds_payload_values(spark):
    rows = spark.createDataFrame(
        [(1, "a.pdf", "ocr"), (2, "b.pdf", "embedded_text")], "id bigint, file_name string, extraction_method string")
    table = rows.withColumns({
        "file_type": F.lit("PDF"), "risk_level": F.lit("Low Risk"), "risk_score": F.lit(5), "detections": F.lit(0),
        "high_severity_detections": F.lit(0), "ocr_status": F.lit("completed"),
        "categories": F.array().cast("array<struct<category:string,n:int>>"), "metadata": history.metadata_payload(rows),
        "created_at": F.lit("2024-01-01").cast("timestamp")})
    found = history.search_rows(history.history_view(table, details=True), '"extraction method":"ocr"')
    assert [r.Document for r in found.collect()] == ["a.pdf"]
