"""A corpus pipeline over `documents`: each stage's result is written as Parquet and reread by the next.

quality classifier -> n-gram Jaccard join (five words, similarity 0.8 or more) -> PII redaction ->
mixing sources to target weights -> best-fit packing. All stages but the last return the columns
of documents; the last returns one row per packed piece. A document that the mix takes several
times is packed as often.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from atlasmill.llm import mixing, ngram_join, packing, pii, quality
from atlasmill.llm.common import stash


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.deduplicated(docs, words=5, percent=80)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: A fitted classifier, a tokenizer and boosted trees are beyond SQL; no test compares run() with a plain Python version yet.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
