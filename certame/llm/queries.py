"""One query for each operator, over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certame.llm import decontamination, divergence, filter_audit, katz, language, licences, neardup, packing, secrets, suffix_dedup, token_files, topk, url_filter
from certame.llm.storage import table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.train(table(spark, sf_dir, "documents"))
    return language.identify(language.page_rows(table(spark, sf_dir, "pages")), model).withColumnRenamed("key", "page_id")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), keep_ids=False).drop("ids")


def op6_katz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op7_top_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.scaled(table(spark, sf_dir, "embeddings"))
    found = topk.exact_top(vectors, vectors.where("vec_id % 20 = 0"))
    return found.withColumn("score", F.col("whole")).drop("whole")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")).drop("spans")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.license_blocks(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_table(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.digest(secrets.find_secrets(docs, secrets.train(secrets.labelled_samples(docs))))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language, op2_url_filter, op3_near_duplicates, op4_decontamination, op5_packing, op6_katz_score, op7_top_search, op8_suffix_dedup, op9_licenses, op10_token_files, op11_filter_audit, op12_secret_scan, op13_source_divergence)}

ORACLES: dict[str, str] = {"op11_filter_audit": filter_audit.SQL, "op13_source_divergence": divergence.SQL}
