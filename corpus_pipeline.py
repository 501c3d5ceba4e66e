"""A corpus pipeline: toxicity, near duplicates, decontamination, source mixing and sharding.

``STAGES`` are applied in order to ``documents``. Each stage reads what the one before it wrote
and, but for the last, returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarden.llm.decontaminate import contaminated, split_item
from docwarden.llm.jaccard_join import jaccard_classes
from docwarden.llm.mixing import mixed_documents
from docwarden.llm.rows import FIRST_MADE_ID, free_name, with_row_ids
from docwarden.llm.shards import kd_shards, number_place
from docwarden.llm.storage import stored
from docwarden.llm.toxicity import toxicity

#: Near duplicates of the pipeline: five-word shingles, similarity 0.8.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key``, which is not null, is not in the one column of ``gone``; without ``key``."""
    other = free_name(docs.columns, "gone")
    found = gone.select(F.col(gone.columns[0]).alias(other)).distinct()
    return docs.join(found, F.col(key) == F.col(other), "left_anti").drop(key)


def _text_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """Add a hash of the text. What depends on the text alone is judged by it, row by row, so that
    null and repeated ids make no difference."""
    key = free_name(docs.columns, "text_key")
    return docs.withColumn(key, F.xxhash64(F.col("text").isNull(), F.col("text"))), key


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine does not reject."""
    named, key = _text_key(docs)
    judged = toxicity(named, _table(spark, sf_dir, "labels"), keep=(key,))
    return _without(named, stored(judged.where("predicted = 1").select(key)), key)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked documents, once.

    Rows with a null or repeated id are documents of their own and come after all others; equal
    rows are one document."""
    key = free_name(docs.columns, "row_id")
    ids = stored(docs.groupBy(F.col("doc_id").cast("long").alias("again")).count().where(
        "count > 1 AND again IS NOT NULL").select("again"))
    named = with_row_ids(docs, key, "doc_id", None if ids.isEmpty() else ids)
    groups = jaccard_classes(named, doc_id=key, size=NEAR_WORDS, percent=NEAR_PERCENT)
    again = stored(groups.where("doc_id <> component_id").select("doc_id"))
    made = stored(groups.where(F.col("doc_id") >= FIRST_MADE_ID).groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if made.isEmpty():
        return _without(named, again, key)
    other = free_name(named.columns, "equal")
    equal = named.join(made.select(F.col("doc_id").alias(other)), F.col(key) == F.col(other), "left_semi")
    once = _without(equal.dropDuplicates([key]), again, key)
    return _without(named, again.unionByName(made), key).unionByName(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    named, key = _text_key(docs)
    question, answer = split_item(F.col("text"))
    found = contaminated(named, _table(spark, sf_dir, "benchmark"), question=question, answer=answer, one_text=True,
                         doc_id=key)
    return _without(named, stored(found.select("doc_id")), key)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's shard and slot."""
    dims = {
        "lang": F.col("lang"), "source": F.col("source"),
        "length": F.log2(number_place(F.col("n_chars")) + 2),
    }
    return kd_shards(docs, dims, shards=8)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source mixing", mix_sources),
    ("sharding", shard),
]

#: Learning a classifier, an aligned search and drawing by hash have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
