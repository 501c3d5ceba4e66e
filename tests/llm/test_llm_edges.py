"""Every operator on nulls, empty and very long texts, repeats, empty tables and clashing columns."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docwarden.llm.decontaminate import contaminated, split_item
from docwarden.llm.html_text import main_texts
from docwarden.llm.jaccard_join import jaccard_classes
from docwarden.llm.licenses import license_spans
from docwarden.llm.line_dedup import dedup_report
from docwarden.llm.mixing import mix, mixed_documents
from docwarden.llm.rabitq import nearest
from docwarden.llm.shards import kd_shards, number_place
from docwarden.llm.toxicity import toxicity
from docwarden.llm.url_filter import Rule, judged

LONG = " ".join(f"word{i} of{i % 7}" for i in range(40_000))
CLASH = ["_gone", "gone", "_times", "_id", "_again", "again", "same", "key", "text_key", "row_id", "times", "equal", "k1", "h1", "place", "id", "n", "h", "size", "line", "part", "bucket", "score", "shard", "rows", "cell", "gram", "_text"]
ROWS = [
    (0, None, "en", "a", 0), (1, "", None, "a", 0), (2, "Released under the MIT License.", "en", None, 30),
    (3, LONG, "en", "b", len(LONG)), (4, LONG, "en", "b", len(LONG)), (None, "some words here", "en", "b", None),
    (5, "some words here", "de", "a", 15), (5, "some words here", "de", "a", 15), (6, " \n\t ", "de", "a", 4),
    (7, "ein einziges Wort\nein einziges Wort", "de", "", 36),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def dims():
    return {"lang": F.col("lang"), "length": number_place(F.col("n_chars"))}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def none(rows):
    return rows.where("false")


def labels(spark, *pairs):
    return spark.createDataFrame(list(pairs), "doc_id long, quality int, toxic int")


def test_sharding(rows, none):
    found = kd_shards(rows, dims(), shards=3).collect()
    assert len(found) == len(ROWS)
    by_id = {r.doc_id: r for r in found}
    assert (by_id[0].size, by_id[0].text_crc32) == (1, 0)
    assert by_id[1].size == 1 and by_id[5].size == 16
    for s in {r.shard for r in found}:
        slots = sorted(r.slot for r in found if r.shard == s)
        assert slots == list(range(len(slots)))
    assert kd_shards(none, dims(), shards=8).count() == 0
    assert {r.shard for r in kd_shards(rows, dims(), target_bytes=10**9).collect()} == {0}


def test_sharding_along_names_with_a_common_beginning(spark):
    rows = [(i, f"text {i}", "en", f"common_crawl_{'ab'[i % 2]}", 9) for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = kd_shards(docs, {"source": F.col("source")}, shards=2).join(docs.select("doc_id", "source"), "doc_id")
    assert {(r.shard, r.source) for r in found.select("shard", "source").distinct().collect()} == {
        (0, "common_crawl_a"), (1, "common_crawl_b")}


def test_sharding_keeps_a_large_group_whole(spark):
    """A group of 7 % of a shard stays together, one of a third of all rows is cut."""
    rows = [(i, f"own text number {i:05d}" + " x" * (i % 13), "en", "a", i) for i in range(3000)]
    rows += [(10_000 + i, "a copy of one text of this size", "en", "a", 40) for i in range(30)]
    found = kd_shards(spark.createDataFrame(rows, SCHEMA), dims(), shards=8)
    assert found.where("doc_id >= 10000").select("shard").distinct().count() == 1
    rows += [(20_000 + i, "a very common copy of one text", "en", "a", 40) for i in range(2000)]
    found = kd_shards(spark.createDataFrame(rows, SCHEMA), dims(), shards=8)
    sizes = [r.w for r in found.groupBy("shard").agg(F.sum("size").alias("w")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.1 * min(sizes)


def test_decontamination(spark, rows, none):
    items = spark.createDataFrame(
        [(1, None), (2, "a b"), (3, LONG), (4, "")], "item_id long, text string").withColumn("q", F.lit(1))
    question, answer = split_item(F.col("text"))
    found = contaminated(rows, items, question=question, answer=answer).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(3, 3), (4, 3)]
    assert contaminated(none, items, question=question, answer=answer).count() == 0
    assert contaminated(rows, items.where("false"), question=question, answer=answer).count() == 0


def test_licenses(rows, none):
    found = [(r.doc_id, r.license, r.first_word, r.last_word) for r in license_spans(rows).collect()]
    assert found == [(2, "MIT", 0, 4)]
    assert license_spans(none).count() == 0


def test_jaccard(rows, none):
    found = sorted(tuple(r) for r in jaccard_classes(rows).where("doc_id IS NOT NULL").collect())
    n = len({tuple(w) for w in zip(*[LONG.split()[k:] for k in range(3)])})
    assert [r for r in found if r[0] in (0, 1, 6)] == [(0, 0, 0), (1, 0, 1), (6, 0, 6)]
    assert (3, n, 3) in found and (4, n, 3) in found
    assert found.count((5, 1, 5)) == 2
    assert [r.component_id for r in jaccard_classes(rows).where("doc_id IS NULL").collect()] == [None]
    assert jaccard_classes(none).count() == 0


def test_nearest(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]),
               (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (9, [0.5, 0.5]), (None, [9.0, 9.0]), (10, [])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("block", F.lit(1))
    got = sorted(tuple(r) for r in nearest(table, F.col("vec_id") % 20 == 0, k=20).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 9, 0.5)]
    assert nearest(table.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest(table, F.lit(False)).count() == 0


def test_mixing(rows, none):
    found = mix(rows).collect()
    assert len(found) == len(ROWS)
    assert all(r.taken <= 2 * r.size for r in found)
    targets = {r.source: (r.source_size, r.target) for r in found}
    assert set(targets) == {"", "a", "b", None}
    taken = {s: sum(r.taken for r in found if r.source == s) for s in targets}
    assert all(abs(taken[s] - targets[s][1]) <= 1 for s in targets)
    assert mix(none).count() == 0
    assert mixed_documents(rows).columns == rows.columns
    assert mixed_documents(none).count() == 0


def test_mix_decides_by_row(spark):
    """Null and repeated ids, and rows that differ in another column only."""
    text = " ".join(["word"] * 10)
    for ids in ([None] * 60 + list(range(60)), [7] * 120, list(range(40)) * 3):
        docs = spark.createDataFrame(
            [(i, f"{text} {k // 3}", "en", ("a", "b")[k % 2], k, {"k": k}) for k, i in enumerate(ids)],
            "doc_id long, text string, lang string, source string, n_chars long, extra map<string,int>")
        mixed = mixed_documents(docs)
        got = {r.source: r.words for r in mixed.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("words")).collect()}
        targets = {r.source: r.target for r in mix(docs).select("source", "target").distinct().collect()}
        assert all(abs(got[s] - targets[s]) <= 11 for s in targets), (got, targets)
        assert mixed.columns == docs.columns
    equal = spark.createDataFrame([(1, text, "en", "a", 5)] * 30 + [(2, text, "en", "b", 5)] * 30, SCHEMA)
    counts = {r.source: r["count"] for r in mixed_documents(equal).groupBy("source").count().collect()}
    assert sum(counts.values()) == 90 and counts["a"] == 60


def test_toxicity(spark, rows, none):
    known = labels(spark, (3, 1, 1), (5, 1, 0), (5, 0, 1), (None, 1, 1), (7, None, None), (2, 1, 7))
    found = toxicity(rows, known).collect()
    assert len(found) == len(ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    assert {r.score for r in toxicity(rows, labels(spark)).collect()} == {0.0}
    assert toxicity(none, known).count() == 0


def test_urls_and_pages(spark):
    long = "<article>" + "".join(f"<p>w{i} &amp; x</p>" for i in range(20_000))
    pages = spark.createDataFrame(
        [(1, "http://A.Example.NET/en/x?q#f", None), (2, None, ""), (3, "no url", "<p>open</p>"),
         (4, "https://b.org", long), (4, "https://b.org", long), (None, "x://b.org/fr/", "<p>&lt;b")],
        "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "path", "lines", "rule")})
    rules = [Rule("net", "/", False), Rule("example.net", "/en/", True), Rule("org", "/fr/", True)]
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in judged(pages, rules).collect()}
    assert got == {
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"),
        (4, "b.org", "", None, "allow"), (None, "b.org", "/fr/", "org/fr/", "allow")}
    texts = sorted(main_texts(pages).where("page_id IS NOT NULL").collect(), key=lambda r: r.page_id)
    assert [r.text for r in texts[:3]] == ["", "", "open"]
    assert len(texts) == 5 and texts[3].text == texts[4].text and texts[3].text.count("\n") == 19_999
    assert all(r.n_chars == len(r.text) for r in texts)
    assert judged(pages.where("false"), rules).count() == 0
    assert main_texts(pages.where("false")).count() == 0


def test_lines(rows, none):
    found = sorted((r.doc_id, r.n_lines, tuple(r.removed)) for r in dedup_report(rows).where("doc_id IS NOT NULL").collect())
    assert found == [(0, 0, ()), (1, 0, ()), (2, 1, ()), (3, 1, ()), (4, 1, (0,)), (5, 1, ()), (5, 1, ()), (6, 2, ()), (7, 2, (1,))]
    assert [r.n_removed for r in dedup_report(rows).where("doc_id IS NULL").collect()] == [1]
    assert dedup_report(none).count() == 0


def test_pipeline_stages(spark, rows, none, tmp_path):
    labels(spark, (3, 1, 0)).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of this is in them at all")], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    for docs in (rows, none):
        kept = [docs]
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, kept[-1], str(tmp_path))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns, name
            folder = f"{tmp_path}/{re.sub(' ', '_', name)}-{docs is none}"
            out.write.parquet(folder)
            kept.append(spark.read.parquet(folder))
        if docs is rows:
            near = {r.doc_id for r in kept[2].collect()}
            assert 3 in near and 4 not in near and {0, 1, 6} <= near
            # the row without an id and the two equal rows are one text
            assert kept[2].where("doc_id = 5 OR doc_id IS NULL").count() == 1
        else:
            assert kept[-1].count() == 0


def test_stages_judge_rows_without_an_id(spark, tmp_path):
    passage = "the quick brown fox jumps over the lazy dog near the old river bank at dawn"
    rows = [(i, f"clean text number {i} about gardens and bread {i * 7} {i * 13}", "en", "a", 5) for i in range(60)]
    rows += [(i, f"you are a vile zorgon fool {i} {i * 3}", "en", "a", 5) for i in range(100, 160)]
    rows += [(None, "you are a vile zorgon fool again", "en", "a", 5), (3, "you are a vile zorgon fool too", "en", "a", 5),
             (None, f"clean text number about gardens and bread {passage}", "en", "a", 5),
             (None, "clean text number about gardens and bread without harm", "en", "a", 5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels(spark, *[(i, 1, 0) for i in range(60)], *[(i, 0, 1) for i in range(100, 160)]).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    calm = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert calm.where("text LIKE '%zorgon%'").isEmpty()
    assert calm.where("doc_id = 3").count() == 1 and calm.where("doc_id IS NULL").count() == 2
    clean = corpus_pipeline.drop_contaminated(spark, calm, str(tmp_path))
    assert [r.text for r in clean.where("doc_id IS NULL").collect()] == ["clean text number about gardens and bread without harm"]
    # of two rows with one id, the copy of another document goes and the other stays
    long = " ".join(f"w{i}" for i in range(40))
    twins = spark.createDataFrame(
        [(1, long, "en", "a", 5), (2, long + " end", "en", "a", 5), (2, "own words of the second row here", "en", "a", 5),
         (None, long, "en", "a", 5), (None, "alone", "en", "a", 5), (None, "alone", "en", "a", 5)], SCHEMA)
    kept = corpus_pipeline.drop_near_duplicates(spark, twins, str(tmp_path))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [
        (0, "alone"), (1, long), (2, "own words of the second row here")]
