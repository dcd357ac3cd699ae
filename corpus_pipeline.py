"""A corpus's way from raw documents to token ids, stage after stage.

Each stage is given all that the one before kept, written and read again, and returns the columns of
``documents``; the last returns token ids in place of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.llm import decontaminate, ngram_join, pieces, quality_classifier, toxicity
from gleanwork.llm.shared import materialise, release

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose neighbours vote for quality."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.select(*COLUMNS)
    return quality_classifier.score(rows, quality_classifier.train(rows, labels), "_score").where(F.col("_score") >= quality_classifier.THRESHOLD).select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain doesn't find toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.select(*COLUMNS)
    return toxicity.score(rows, toxicity.train(rows, labels)).where("not is_toxic").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.keep_one(docs.select(*COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    rows = docs.select(*COLUMNS)
    found = decontaminate.find(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("row_key").alias("_hit")).distinct()
    found = materialise(found, "bench-found")  # its size decides about a broadcast
    return rows.join(found, F.xxhash64("doc_id", "text") == F.col("_hit"), "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text."""
    return pieces.tokenize(docs.select(*COLUMNS)).drop("text")


STAGES = [("quality", quality), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("tokens", tokens)]

#: SQL can't express the classifiers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
