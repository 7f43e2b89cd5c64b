"""A corpus from documents to packed sequences in five stages.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept; what it returns
is written as Parquet and read again for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roamgrid.llm import exact_dedup, jaccard_join, mixing, packing, quality
from roamgrid.llm._common import cut


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are rejected as low quality or toxic go."""
    return quality.keep_good(docs, quality.graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after lower-casing A-Z, the one with the largest id stays."""
    return exact_dedup.keep_one(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return jaccard_join.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order in which the mix releases them."""
    return mixing.in_mixed_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' pieces and their places in sequences, which follow the order of the mix: stretches of it are packed one by one."""
    return packing.pack_in_order(docs)


STAGES = [("quality classifier", classify), ("exact dedup", dedup_exact), ("n-gram Jaccard join", dedup_near), ("mixing sources", mix_sources), ("best-fit packing", pack)]

#: The classifier and the packing can't be expressed in SQL; tests/llm/test_pipeline.py compares all stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
