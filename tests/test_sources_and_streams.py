import csv
import datetime
import io
import json

import pytest
from pyspark.sql import functions as F

from docwarden.operators import detect, monitoring, risk
from docwarden.plans.enriched import enriched_documents
from docwarden.plans.queries import QUERIES
from docwarden.sources import files, pages, sinks
from docwarden.sources.csv_text import csv_row_documents, flatten_csv, infer_delimiter
from docwarden.streaming import jobs, keyed


@pytest.mark.parametrize("data", [
    "plain é".encode(), b"\xef\xbb\xbfmarked", "caf\xe9 “q”".encode("cp1252"),
    b"bad \x81 \x93 \xff", b"", "अआ".encode(),
])
def test_decode_cascade(spark, data):
    for encoding in ("utf-8-sig", "utf-8", "cp1252", "latin-1"):
        try:
            want = data.decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    df = spark.createDataFrame([(bytearray(data),)], "c binary")
    assert df.select(files.decode_text(F.col("c")).alias("t")).first().t == want


CSVS = [
    "", "a,b,c", "a,b\n1,2\n3", "a,,c\n1,2,3,4\n\n5\n", 'n,t\n1,"x, ""y""\nz"\n2,"q"tail\n3,m"id\n',
    "h;i\n1;2,5\n3;4\n", "h\ti\n1\t2\n", "h|i\r\n1|2\r\n3|4", 'a,b\n"",""\n"unterminated, x\ny', ",\n,\n",
]


@pytest.mark.parametrize("text", CSVS)
def test_flatten_csv_matches_csv_reader(spark, text):
    df = spark.createDataFrame([(text,)], "t string").withColumn("d", infer_delimiter(F.col("t")))
    row = df.select("d", flatten_csv(F.col("t"), F.col("d")).alias("f")).first()
    want_delim = next((d for d in ",;\t|" if d in text.split("\n")[0]), ",")
    assert row.d == want_delim
    rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=row.d))
    if not rows:
        assert (row.f.text, row.f.rows, row.f.columns) == ("", 0, 0)
        return
    head, lines = rows[0], []
    for n, cells in enumerate(rows[1:], 1):
        pairs = [f"{head[i] if i < len(head) and head[i] else f'column_{i + 1}'}: {v}"
                 for i, v in enumerate(cells)]
        lines.append(f"Row {n}: " + "; ".join(pairs))
    if len(rows) == 1:
        lines.append("; ".join(head))
    assert row.f.text == "\n".join(lines)
    assert (row.f.rows, row.f.columns) == (len(rows) - 1, len(head))


def test_read_documents(spark, tmp_path):
    (tmp_path / "notes.v1.TXT").write_bytes(b"\xef\xbb\xbf  Email a@b.com \n")
    (tmp_path / "people.csv").write_text("name,email\nAnn,ann@x.org\n")
    (tmp_path / "image.png").write_bytes(b"x")
    (tmp_path / "noext").write_bytes(b"x")
    docs, rejects = files.read_documents(spark, str(tmp_path))
    rows = {r.file_name: r for r in docs.collect()}
    assert rows["notes.v1.TXT"].text == "Email a@b.com" and rows["notes.v1.TXT"].characters == 17
    assert rows["notes.v1.TXT"].file_type == "TXT" and rows["notes.v1.TXT"].rows is None
    csv_row = rows["people.csv"]
    assert (csv_row.text, csv_row.rows, csv_row.columns) == ("Row 1: name: Ann; email: ann@x.org", 1, 2)
    assert {r.file_name for r in rejects.collect()} == {"image.png", "noext"}


def test_csv_rows_as_documents(spark):
    df = spark.createDataFrame([(1, "a,b\n1,2\n3,4\n")], "doc_id bigint, content_text string")
    assert [(r.row_no, r.text) for r in csv_row_documents(df).orderBy("row_no").collect()] == [
        (1, "Row 1: a: 1; b: 2"), (2, "Row 2: a: 3; b: 4")]


def test_pages_and_ocr(spark):
    schema = "doc_id int, page_no int, text string"
    own = spark.createDataFrame([(1, 1, ""), (2, 2, "second"), (2, 1, "x" * 60), (3, 1, None), (4, 1, "")], schema)
    ocr = spark.createDataFrame([(1, 1, "OCR email scan@example.com"), (2, 1, "no"), (4, 1, "")], schema)
    rows = {r.doc_id: r for r in pages.assemble_pages(own, ocr).collect()}
    assert rows[1].text == "--- OCR Page 1 ---\nOCR email scan@example.com"
    assert (rows[1].extraction_method, rows[1].ocr_status) == ("ocr", "completed")
    assert rows[2].text == f"--- Page 1 ---\n{'x' * 60}\n\n--- Page 2 ---\nsecond"
    assert rows[2].ocr_status == "not_needed" and rows[2].pages == 2
    assert (rows[3].extraction_method, rows[3].ocr_status) == ("embedded_text", "ocr_dependencies_missing")
    many = spark.range(10_001).select(F.lit(9).alias("doc_id"), (F.col("id") + 1).cast("int").alias("page_no"),
                                      F.lit("t").alias("text"))
    whole = pages.assemble_pages(many).collect()
    assert [p.pages for p in whole] == [10_001] and whole[0].text.endswith("--- Page 10001 ---\nt")
    only_ocr = pages.assemble_pages(own.where("doc_id = 2"), ocr.where("doc_id = 1")).where("doc_id = 1").first()
    assert (only_ocr.text, only_ocr.extraction_method) == ("--- OCR Page 1 ---\nOCR email scan@example.com", "ocr")


def test_sinks(spark, docs, tmp_path):
    scans = detect.scan(docs("PAN ABCDE1234F", "<b> & a@b.com"))
    sinks.write_redacted(scans, str(tmp_path / "red"))
    assert {r.redacted_text for r in spark.read.parquet(str(tmp_path / "red")).collect()} == {
        "PAN [REDACTED PAN NUMBER]", "<b> & [REDACTED EMAIL ADDRESS]"}
    listed = docs("PAN ABCDE1234F", "<b> & a@b.com").withColumn("ocr_status", F.lit(None).cast("string"))
    users = spark.createDataFrame([(1, "one@example.org")], "id int, email string")
    log = sinks.scan_log(listed, risk.assess_groups(scans, "batch_id"), "2024-01-01T00:00:00Z", users)
    sinks.write_jsonl(log, str(tmp_path / "log"), "0")
    line = json.loads(next(p for p in (tmp_path / "log" / "run=0").iterdir() if p.suffix == ".json").read_text())
    assert line["file_count"] == 2 and line["detections"] == 2 and line["user_email"] == "one@example.org"
    assert sinks.scan_log_files(listed).count() == 2
    assert line["categories"] == {"PAN Number": 1, "Email Address": 1}
    assert "ABCDE1234F" not in json.dumps(line)
    html = sinks.html_page(docs("<a> & 'b'"), "T", "text").first().html
    assert "&lt;a&gt; &amp; &#x27;b&#x27;" in html
    blocks = sinks.rows_as_text(spark.createDataFrame([(1, "x", None)], "row_no int, k string, v string"))
    assert blocks.first().value == "1.\nk: x\nv: None"


def test_trace_rows_hash_and_local_names(spark):
    calls = spark.createDataFrame(
        [(1, 1, "a", "qa", "groq", "m", False, "ok", 5, "out", None)],
        "id int, user_id int, analysis_id string, feature string, provider string, model string, "
        "has_key boolean, status string, latency_ms int, output string, created_at timestamp")
    row = monitoring.trace_rows(calls).first()
    assert (row.model_provider, row.model_name, row.prompt_version) == ("local", "local-ai-ml-fallback", "compliance-v2")
    assert len(row.output_hash) == 16


def test_stream_scan_equals_batch(spark, sf, tmp_path):
    folder = str(tmp_path / "in")
    enriched_documents(spark, sf).repartition(3).write.parquet(folder)
    stream = jobs.read_stream(spark, folder, spark.read.parquet(folder).schema, 1)
    done = (jobs.stream_scan(stream).writeStream.format("parquet")
            .option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out"))
            .trigger(availableNow=True).start())
    done.awaitTermination()
    columns = ["doc_id", "risk_level", "risk_score", "n_findings", "redacted_text"]
    got = spark.read.parquet(str(tmp_path / "out")).select(columns)
    want = jobs.stream_scan(spark.read.parquet(folder)).select(columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.mark.parametrize("name", ["stream_scan", "stream_persist", "stream_monitor", "stream_scan_monitor"])
def test_stream_queries_read_tables_that_are_folders(spark, sf, tmp_path, name):
    for table in ("documents", "conversations", "events"):
        spark.read.parquet(f"{sf}/{table}.parquet").repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
    got, want = QUERIES[name](spark, str(tmp_path)), QUERIES[name](spark, sf)
    assert not want.isEmpty()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.mark.parametrize("name", ["stream_scan", "stream_persist", "stream_monitor", "stream_scan_monitor"])
def test_stream_queries_read_tables_whose_folders_name_a_column(spark, sf, tmp_path, name):
    for table, column in (("documents", "lang"), ("conversations", "role"), ("events", "event_type")):
        spark.read.parquet(f"{sf}/{table}.parquet").write.partitionBy(column).parquet(str(tmp_path / f"{table}.parquet"))
    got, want = QUERIES[name](spark, str(tmp_path)), QUERIES[name](spark, sf)
    assert not want.isEmpty()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def _events(spark, rows, folder):
    schema = "analysis_id string, created_at timestamp, status string, model_provider string, latency_ms int"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return schema


def test_stream_persist_writes_each_analysis_once(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 10)
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    schema = _events(spark, [("a", at, "s", "p", 1), ("a", at, "s", "p", 1), ("b", at, "s", "p", 2)], src)
    for checkpoint in ("c1", "c1", "c2"):  # the last run replays everything
        jobs.stream_persist(jobs.read_stream(spark, src, schema), out, str(tmp_path / checkpoint),
                            available_now=True).awaitTermination()
    _events(spark, [("c", at + datetime.timedelta(hours=3), "s", "p", 3), ("a", at, "s", "p", 1)], src)
    jobs.stream_persist(jobs.read_stream(spark, src, schema), out, str(tmp_path / "c1"),
                        available_now=True).awaitTermination()
    assert sorted(r.analysis_id for r in keyed.read_keyed(spark, out).collect()) == ["a", "b", "c"]


def test_stream_monitor_drops_late_rows(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 10)
    hour = datetime.timedelta(hours=1)
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    schema = _events(spark, [("a", at, "Rules fallback", "groq", 10), ("b", at, "ok", "local", 30),
                             ("c", at, "ok", "groq", 5)], src)

    def run():
        q = (jobs.monitor(jobs.read_stream(spark, src, schema)).writeStream.outputMode("append")
             .format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c"))
             .trigger(availableNow=True).start())
        q.awaitTermination()

    run()
    _events(spark, [("d", at + 3 * hour, "ok", "groq", 1)], src)
    run()
    _events(spark, [("late", at, "ok", "groq", 99), ("e", at + 9 * hour, "ok", "groq", 1)], src)
    run()
    rows = {r.window_start: r for r in spark.read.parquet(out).collect()}
    first = rows[at]
    assert (first.calls, first.fallbacks, first.max_latency_ms) == (3, 2, 30)
    assert round(first.fallback_rate, 6) == 0.666667
    assert at + 3 * hour in rows
    batch = jobs.monitor(spark.read.parquet(src)).where(F.col("window_start") == at).first()
    assert batch.calls == 4


def test_scan_monitor_counts_each_document_once_and_late_ones(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 10)
    hour = datetime.timedelta(hours=1)
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    schema = "doc_id bigint, text string, created_at timestamp, status string, model_provider string"

    def feed(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        docs = jobs.read_stream(spark, src, schema)
        query = (jobs.scan_monitor(risk.assess(detect.scan(docs)), delay="30 minutes").writeStream.outputMode("append")
                 .format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c"))
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        return jobs.late_rows(query)

    pan = "PAN ABCDE1234F and a@b.com"
    assert feed((1, pan, at, "ok", "groq"), (2, "nothing", at, "Rules fallback", "groq"), (1, pan, at, "ok", "groq")) == 0
    assert feed((3, pan, at + 3 * hour, "ok", "local")) == 0
    # three documents older than the watermark, two of them in one window
    assert feed((4, pan, at, "ok", "groq"), (5, pan, at, "ok", "groq"), (6, pan, at + hour, "ok", "groq"),
                (7, pan, at + 6 * hour, "ok", "groq")) == 3
    feed((8, "end", at + 9 * hour, "ok", "groq"))
    got = {r.window_start: (r.documents, r.findings, r.fallbacks, r.fallback_rate) for r in spark.read.parquet(out).collect()}
    assert got == {at: (2, 2, 1, 0.5), at + 3 * hour: (1, 2, 1, 1.0), at + 6 * hour: (1, 2, 0, 0.0)}
    batch = jobs.scan_monitor(risk.assess(detect.scan(spark.read.parquet(src).dropDuplicates(["doc_id"]).where("doc_id NOT IN (4, 5, 6)"))))
    on_time = {r.window_start: (r.documents, r.findings, r.fallbacks, r.fallback_rate) for r in batch.collect()}
    assert got == {w: v for w, v in on_time.items() if w in got}


def test_file_stream_takes_new_files_and_rejects(spark, tmp_path):
    (tmp_path / "in").mkdir()
    done = str(tmp_path / "documents"), str(tmp_path / "rejects"), str(tmp_path / "state")

    def run():
        jobs.stream_documents(jobs.file_stream(spark, str(tmp_path / "in"), max_files=2), *done,
                              available_now=True).awaitTermination()
        return ({r.file_name: r.text for r in spark.read.parquet(done[0]).collect()},
                sorted(r.file_name for r in spark.read.parquet(done[1]).collect()))

    (tmp_path / "in" / "a.txt").write_bytes("café “q”".encode("cp1252"))
    (tmp_path / "in" / "b.csv").write_text("n;m\n1;2\n")
    (tmp_path / "in" / "c.png").write_bytes(b"\x00")
    first = ({"a.txt": "café “q”", "b.csv": "Row 1: n: 1; m: 2"}, ["c.png"])
    assert run() == first and run() == first
    (tmp_path / "in" / "sub").mkdir()
    (tmp_path / "in" / "sub" / "d.TXT").write_bytes(b"\xef\xbb\xbfmore")
    assert run() == (first[0] | {"d.TXT": "more"}, ["c.png"])


def test_spread_leaves_inputs_with_enough_splits_alone(spark, sf):
    docs = enriched_documents(spark, sf)
    assert "Exchange" in detect.spread(docs)._jdf.queryExecution().executedPlan().toString()
    assert detect.spread(docs, 1) is docs
    many = spark.range(0, 100, 1, 16)
    assert detect.spread(many, 16) is many


@pytest.mark.parametrize("name", ["csv_flatten", "csv_delimiters"])
def test_csv_queries_flatten_one_file_on_all_cores(spark, sf, name):
    parts = QUERIES[name](spark, sf).groupBy(F.spark_partition_id()).count().count()
    assert parts >= spark.sparkContext.defaultParallelism


def test_csv_steps_are_evaluated_once(spark):
    frame = spark.createDataFrame([("a;b",)], "t string").select(infer_delimiter(F.col("t")).alias("d"))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and plan.count("split(") == 1
