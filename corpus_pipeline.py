"""From documents to token sequences: language ID, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written and read
again as the docs of the next one. All but the last return the columns of documents. Rows without a doc_id go at the first stage:
no later decision could name them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certame.llm import decontamination, language, neardup, packing, suffix_dedup
from certame.llm.storage import keep_until_exit, removed, shared_dir, small_batches, staged, table, without

#: Rows of an Arrow batch: executors keep the memory of all stages before.
PIPELINE_BATCH_ROWS = 250


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled rows know stay; the others, null and empty texts, those without letters and rows without doc_id go.

    Rows of one doc_id go together if one of them is rejected. All columns stay, whatever their names; an empty table stays empty.
    """
    small_batches(spark, PIPELINE_BATCH_ROWS)
    docs = docs.where("doc_id is not null")
    found = language.identify(language.document_rows(docs), language.train(docs))
    return without(docs, found.where("not accepted").select(F.col("key").alias("doc_id")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the smallest doc_id, in one row.

    Texts without words are alike to nothing and stay. Of rows that share a doc_id one stays, any of them. Columns, very long texts and empty tables as before.
    """
    found = staged(neardup.near_duplicates(docs), "groups")
    kept = without(docs, found.where("not kept").select("doc_id"))
    twice = staged(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "twice")
    return without(kept, twice).unionByName(kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand earlier in the corpus are cut from the texts; every document stays.

    Null texts stay null, one that goes whole becomes empty, n_chars (if there) follows; other columns stay.
    """
    small_batches(spark, PIPELINE_BATCH_ROWS)
    return suffix_dedup.without_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak an item of the benchmark go; null and empty texts leak nothing, and null or empty items are leaked by none.

    Rows of one doc_id go together if one of them leaks. Columns stay.
    """
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.where("contaminated").select("doc_id"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 token ids, in pieces of documents; null and empty texts are an end mark alone. Only the pieces' own columns are returned."""
    small_batches(spark, PIPELINE_BATCH_ROWS)
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup_stage),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Tokens, suffix comparison and latent search have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        path = keep_until_exit(spark, f"{shared_dir(spark)}/certame/stage-{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            removed(before)
        before = docs
    return docs
