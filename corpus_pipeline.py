"""The corpus pipeline: toxicity, quality rules, n-gram Jaccard join, suffix-array dedup, best-fit packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leakscan.llm.stages import STAGES

ORACLE_SQL = None  # learned models and token packing can't be written in SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other, over the whole documents table."""
    from leakscan.llm._common import durable

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs, name)
    return docs
