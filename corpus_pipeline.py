"""A training corpus from raw documents: good texts, no near copies, no repeated passages, mixed, packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqrisk.llm.mixing import mixed_documents
from seqrisk.llm.packing import packed_sequences
from seqrisk.llm.paragraphs import documents_without_repeats
from seqrisk.llm.quality import good_documents
from seqrisk.llm.simhash import without_near_copies
from seqrisk.plans.joins import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise quality classifier accepts; it learns from ``labels``."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    return without_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has; emptied documents go."""
    return documents_without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their sequence and place."""
    return packed_sequences(docs)


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("packing", packing),
]

#: Fitted models, fingerprints' components and packing have no SQL; the tests compare each stage with a direct version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
