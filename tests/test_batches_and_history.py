import hashlib

import pytest

from docwarden.operators import batches, detect, history, risk, scale
from pyspark.sql import functions as F


def measured(spark, n, hot=0.5):
    """Documents of which half share one batch; ids are spread out."""
    return spark.range(n).select(
        F.when(F.col("id") < n * hot, F.lit(0)).otherwise(F.col("id") % 5 + 1).alias("batch_id"),
        (F.col("id") * 37).alias("doc_id"), F.lit(9).alias("user_id"),
        F.concat(F.lit("f"), F.col("id").cast("string")).alias("file_name"),
        F.lit("TXT").alias("file_type"), (F.col("id") % 11 + 1).cast("int").alias("characters"),
        (F.col("id") % 3).cast("int").alias("n_findings"),
        F.when(F.col("id") % 2 == 0, "completed").alias("ocr_status"), F.lit(1).alias("pages"),
    )


@pytest.mark.parametrize("order", ["doc_id", "hashed", "named"])
@pytest.mark.parametrize("partitions", [None, 1, 7])
def test_ordered_prefix_over_range_partitions(spark, order, partitions):
    df = measured(spark, 500).withColumns({
        "hashed": F.xxhash64("doc_id"), "named": F.md5(F.col("doc_id").cast("string")),
        "batch_id": F.when(F.col("batch_id") > 0, F.col("batch_id"))})
    got = scale.ordered_prefix(df, "batch_id", order, {"before": F.col("characters"), "rank": F.lit(1)}, partitions).toPandas()
    assert len(got) == 500
    for _, g in got.sort_values(order).groupby("batch_id", dropna=False):
        assert list(g["before"]) == list(g.characters.cumsum() - g.characters)
        assert list(g["rank"]) == list(range(len(g)))


def test_one_batch_of_all_rows_is_cut_into_even_parts(spark):
    df = spark.range(40_000).select(F.lit(1).alias("batch_id"), F.xxhash64("id").alias("doc_id"))
    sizes = [r["count"] for r in scale.range_cut(df, "batch_id", "doc_id", partitions=16).groupBy("_part").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 40_000 / 16


def test_salted_lookup_keeps_every_row(spark):
    rows = measured(spark, 300)
    totals = rows.groupBy("batch_id").agg(F.count("*").alias("n")).where("batch_id < 4")
    left = scale.salted_lookup(rows, totals, ["batch_id"], F.col("doc_id"))
    assert left.count() == 300 and left.where("n IS NULL").count() == rows.where("batch_id >= 4").count()
    inner = scale.salted_lookup(rows, totals, ["batch_id"], F.col("doc_id"), "inner")
    assert inner.count() == rows.where("batch_id < 4").count()


def texts(spark):
    rows = [(0, i, 9, f"f{i}.txt", "TXT", f"text {i} a@b.com ") for i in range(7)]
    rows.append((1, 50, 9, "solo.txt", "TXT", "PAN ABCDE1234F"))
    return spark.createDataFrame(
        rows, "batch_id bigint, doc_id bigint, user_id bigint, file_name string, file_type string, text string"
    ).withColumn("characters", F.length("text"))


def combined(rows):
    if len(rows) == 1:
        return rows[0].text
    return "".join(f"\n\n===== Document: {r.file_name} ({r.file_type}) =====\n{r.text}" for r in rows)


def test_combined_text_and_ranges(spark):
    docs = texts(spark)
    rows = docs.orderBy("doc_id").collect()
    whole = {b: combined([r for r in rows if r.batch_id == b]) for b in (0, 1)}
    sections = batches.combine_text(docs)
    assert sections.count() == len(rows)
    for r in sections.collect():
        assert whole[r.batch_id][r.section_start:].startswith(r.section)
    assert {r.batch_id: r.text for r in batches.join_sections(sections).collect()} == whole
    for r in batches.source_ranges(docs).collect():
        text = next(d.text for d in rows if d.doc_id == r.doc_id)
        assert whole[r.batch_id][r.start:r.end] == text


def test_sources_of_spans_include_both_ends(spark):
    ranges = spark.createDataFrame([(0, "a", 10, 20), (0, "b", 20, 30), (0, "c", 40, 9000)],
                                   "batch_id int, file_name string, start bigint, end bigint")
    spans = spark.createDataFrame([(0, s, s + 1, "X") for s in (9, 10, 20, 21, 30, 31, 40, 8999, 9000, 9001)],
                                  "batch_id int, start bigint, end bigint, category string")
    for width in (4, 1000, 1 << 20):
        got = {r.start: r.source for r in batches.map_to_source(spans, ranges, width).collect()}
        assert got == {9: "Unknown", 10: "a", 20: "a", 21: "b", 30: "b", 31: "Unknown", 40: "c",
                       8999: "c", 9000: "c", 9001: "Unknown"}


def test_scanning_documents_attributes_findings(spark):
    facts = detect.explode_findings(detect.scan(texts(spark)), "file_name")
    got = {(r.file_name, r.category) for r in facts.collect()}
    assert ("solo.txt", "PAN Number") in got and ("f3.txt", "Email Address") in got


def test_counts_and_files_are_separate(spark):
    docs = measured(spark, 60)
    counts = {r.batch_id: r for r in batches.batch_totals(docs).collect()}
    files = batches.batch_files(docs).collect()
    assert len(files) == 60 and len(counts) == docs.select("batch_id").distinct().count()
    for b, c in counts.items():
        assert c.files == sum(f.batch_id == b for f in files)
    assert {f.listing.split(": ")[1] for f in files} == {"completed", "not_applicable"}


def by_formula(user, pieces):
    """Digest of the document digests in blocks."""
    leaves = [hashlib.sha256(p).hexdigest() for p in pieces]
    size = batches.FINGERPRINT_BLOCK
    blocks = [hashlib.sha256("".join(leaves[i:i + size]).encode()).hexdigest() for i in range(0, len(leaves), size)]
    return hashlib.sha256((str(user) + "".join(blocks)).encode()).hexdigest()


def test_fingerprints(spark):
    docs = texts(spark)
    rows = [r for r in docs.orderBy("doc_id").collect() if r.batch_id == 0]
    analysis = [f"{r.file_name}{len(r.text)}{r.text[:500]}".encode() for r in rows]
    upload = [f"{r.file_name}{len(r.text.encode())}".encode() + hashlib.sha256(r.text.encode()).digest() for r in rows]
    got = {r.batch_id: r.fingerprint for r in batches.analysis_fingerprint(docs).collect()}
    assert got[0] == by_formula(9, analysis)
    files = docs.withColumn("content", F.col("text").cast("binary"))
    assert {r.batch_id: r.fingerprint for r in batches.upload_fingerprint(files).collect()}[0] == by_formula(9, upload)


def test_one_fingerprint_formula_for_every_size(spark):
    for n in (1, 10, 10_001):
        docs = spark.range(n).select(
            F.lit(0).alias("batch_id"), F.lit(9).alias("user_id"), F.col("id").alias("doc_id"),
            F.concat(F.lit("f"), F.col("id").cast("string")).alias("file_name"),
            F.repeat(F.lit("ab"), F.lit(300)).alias("text"))
        pieces = [f"f{i}600{'ab' * 250}".encode() for i in range(n)]
        assert batches.analysis_fingerprint(docs.repartition(7)).first().fingerprint == by_formula(9, pieces)
        whole = [f"f{i}600{'ab' * 300}".encode() for i in range(n)]
        assert batches.analysis_fingerprint(docs, chars=None).first().fingerprint == by_formula(9, whole)


def test_counts_beyond_int_range(spark):
    """A group of more findings than an INT holds."""
    one = "named_struct('category', 'PAN Number', 'start', 0)"
    kinds = "array<struct<category:string,start:int>>"
    docs = spark.range(3000).selectExpr(
        "0 AS batch_id", "id AS doc_id", "'f' AS file_name", "'TXT' AS file_type", "'x' AS text",
        f"cast(array({one}) AS {kinds}) AS findings")
    many = risk.assess_groups(docs, "batch_id").first()
    assert (many.n_findings, many.n_high) == (3000, 3000)
    schema = dict(risk.assess_groups(docs, "batch_id").dtypes)
    assert schema["n_findings"] == schema["n_high"] == "bigint" and "n:bigint" in schema["ranked"]


def test_batch_dashboard(spark):
    rows = batches.batch_dashboard(measured(spark, 30)).collect()
    top = {}
    for r in rows:
        top[r.batch_id] = max(top.get(r.batch_id, 0), r.findings)
    assert all((r.priority == "Review first") == (r.findings == top[r.batch_id] > 0) for r in rows)


def test_persist_once(spark):
    new = spark.createDataFrame([("a",), ("a",), ("b",)], "analysis_id string")
    old = spark.createDataFrame([("b",)], "analysis_id string")
    assert [r.analysis_id for r in batches.persist_once(new, old).collect()] == ["a"]
    timed = spark.createDataFrame([("a", 2, "late"), ("a", 1, "z"), ("a", 1, "y")], "analysis_id string, at int, v string")
    assert [tuple(r) for r in batches.persist_once(timed, old, "at").collect()] == [("a", 1, "y")]


def test_history_rows_repeat_batch_risk(spark):
    docs = texts(spark)
    rows = history.history_rows(
        docs.withColumns({"ocr_status": F.lit(None).cast("string"), "created_at": F.current_timestamp()}),
        risk.assess_groups(detect.scan(docs), "batch_id")).where("batch_id = 0").collect()
    assert len(rows) == 7 and {r.detections for r in rows} == {7}


def test_dashboards(spark):
    users = spark.createDataFrame([(1, "u1@x.y"), (2, "u2@x.y")], "id bigint, email string").withColumn(
        "created_at", F.lit("2024-01-01").cast("timestamp"))
    rows = [(i, (1, 1, 3)[i % 3], f"f{i}", "High Risk" if i % 2 else "Low Risk", i) for i in range(9)]
    facts = spark.createDataFrame(
        rows, "id bigint, user_id bigint, file_name string, risk_level string, risk_score int"
    ).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    assert [r.id for r in history.latest(facts, 3, user_id=1).collect()] == [7, 6, 4]
    assert {r.id for r in history.admin_documents(facts, users).collect()} == {0, 1, 3, 4, 6, 7}
    counts = {r.id: r.document_count for r in history.admin_users(users, facts).collect()}
    assert counts == {1: 6, 2: 0}
    audits = history.admin_audits(facts, users, 4).collect()
    assert {r.id: r.email for r in audits} == {8: None, 7: "u1@x.y", 6: "u1@x.y", 5: None}
    assert history.history_metrics(facts).first().latest_score == 8
    assert history.admin_totals(users, facts, facts).first().high_risk_documents == 4


def test_search_covers_keys_and_values(spark):
    view = spark.createDataFrame([("A.txt", "Low Risk"), ("B.txt", "High Risk")], "Document string, Risk string")
    assert history.search_rows(view, "a.TXT").count() == 1
    assert history.search_rows(view, "risk").count() == 2
    assert history.search_rows(view, "", ["High Risk"]).count() == 1


def test_upsert_users(spark):
    users = spark.createDataFrame([(1, "a@x.y", "Ann", "user")], "id bigint, email string, full_name string, role string")
    for name, dtype, default in (("auth_provider", "string", "password"), ("provider_subject", "string", None),
                                 ("created_at", "timestamp", None), ("last_login_at", "timestamp", None)):
        users = history.ensure_column(users, name, dtype, default)
    profiles = spark.createDataFrame(
        [(" A@X.Y ", " ", "g", "s"), ("new@x.y", "New", "g", "t"), ("bad@host", "No", "g", "u"), ("bad", "No", "g", "v")],
        "email string, full_name string, auth_provider string, provider_subject string"
    ).withColumn("last_login_at", F.current_timestamp())
    got = {r.email: r for r in history.upsert_users(users, profiles).collect()}
    assert set(got) == {"a@x.y", "new@x.y"}
    assert got["a@x.y"].full_name == "Ann" and got["a@x.y"].auth_provider == "g"
    assert got["new@x.y"].full_name == "New" and got["new@x.y"].role == "user"


def test_plans_of_dashboards(spark, sf):
    from docwarden.plans.queries import QUERIES

    text = QUERIES["user_documents"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in text and "EqualTo(o_custkey,7)" in text
    text = QUERIES["user_documents_all"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text


def _people(spark):
    users = spark.range(20).select(F.col("id"), F.concat(F.lit("u"), F.col("id"), F.lit("@x.org")).alias("email"),
                                   F.timestamp_seconds(F.col("id")).alias("created_at"))
    scans = spark.range(3_000).select(
        "id", F.when(F.col("id") < 40, F.col("id") % 20).when(F.col("id") % 100 == 0, F.col("id") % 7)
        .otherwise(F.lit(999)).alias("user_id"), F.timestamp_seconds(F.col("id")).alias("created_at"))
    return users, scans


@pytest.mark.parametrize("limit", [2, 5, 50, 500])
def test_admin_documents_widens_until_enough_users_are_known(spark, limit):
    users, scans = _people(spark)
    expected = scans.join(users.select(F.col("id").alias("user_id"), "email"), "user_id").orderBy(
        F.desc("created_at"), F.desc("id")).limit(limit)
    got = history.admin_documents(scans, users, limit)
    assert [(r.id, r.email) for r in got.orderBy(F.desc("created_at"), F.desc("id")).collect()] == [
        (r.id, r.email) for r in expected.collect()]


def test_admin_documents_does_not_join_history(spark):
    users, scans = _people(spark)
    recent = scans.where("id < 40")
    plan = history.admin_documents(recent, users, 10)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_admin_users_are_newest_first(spark):
    users, scans = _people(spark)
    rows = history.admin_users(users, scans).collect()
    assert [r.id for r in rows] == list(range(19, -1, -1)) and rows[-1].document_count >= 2
