"""The registered queries of the subpackage, over the tables below a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarden.llm.conversations import damaged, repair_report
from docwarden.llm.decontaminate import contaminated, split_item
from docwarden.llm.html_text import main_texts
from docwarden.llm.jaccard_join import jaccard_classes
from docwarden.llm.lattice import near_vectors
from docwarden.llm.licenses import license_spans
from docwarden.llm.line_dedup import dedup_report
from docwarden.llm.manifest import every_fifth, manifest
from docwarden.llm.mixing import mix
from docwarden.llm.oracle import ORACLE
from docwarden.llm.rabitq import nearest
from docwarden.llm.shards import kd_shards, number_place
from docwarden.llm.toxicity import toxicity
from docwarden.llm.url_filter import Rule, judged


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    dims = {
        "lang": F.col("lang"), "source": F.col("source"),
        "length": F.log2(number_place(F.col("n_chars")) + 2),
    }
    placed = kd_shards(docs, dims, shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    question, answer = split_item(F.col("text"))
    return contaminated(
        _table(spark, folder, "documents"), _table(spark, folder, "benchmark"),
        question=question, answer=answer, one_text=True)


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_spans(_table(spark, folder, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_classes(_table(spark, folder, "documents"))


def op5_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    drawn = mix(_table(spark, folder, "documents"))
    return drawn.select("doc_id", "size", "source_size", "target", "taken",
                        F.transform("draws", lambda d: d.shard).alias("shards"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


RULES = [
    Rule("net", "/", False), Rule("example.net", "/en/", True),
    Rule("example.com", "/de/", False), Rule("org", "/fr/", True),
]


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judged(_table(spark, folder, "pages"), RULES, by_own_links=True)


def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return main_texts(_table(spark, folder, "pages"))


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = dedup_report(_table(spark, folder, "documents"))
    return found.withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))


def op11_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(_table(spark, folder, "embeddings"))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "conversations")
    return repair_report(damaged(rows), rows.select("conv_id"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest(_table(spark, folder, "documents"), tampered=every_fifth())


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_decontamination": op2_decontamination,
    "op3_license_scan": op3_license_scan,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_url_filter": op8_url_filter,
    "op9_html_extraction": op9_html_extraction,
    "op10_line_dedup": op10_line_dedup,
    "op11_embedding_near_dedup": op11_embedding_near_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_merkle_manifest": op13_merkle_manifest,
    "pipeline": pipeline,
}

__all__ = ["ORACLE", "QUERIES"]
