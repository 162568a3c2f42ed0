"""A corpus pipeline from five operators: documents in, token files out.

``STAGES`` are meant to be run one after another, each on the Parquet files that the stage before
it wrote; ``run`` does so below the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracebound.llm.batches import removed_folder
from tracebound.llm.decontaminate import clean_documents
from tracebound.llm.mixing import mixed_documents
from tracebound.llm.quality import kept_documents
from tracebound.llm.queries import table, tokenizer_file
from tracebound.llm.simhash import one_of_each
from tracebound.llm.tokens import round_trip, shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return kept_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without too much benchmark text."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the written token files hold of every document."""
    return round_trip(docs, tokenizer_file())


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source mixing", source_mixing),
    ("token files", token_files),
]

#: Forests, fingerprints and random rounding have no SQL form; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage wrote is removed when the next one has read it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            removed_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    last = STAGES[-1][1](spark, docs, sf_dir)  # has written its own files
    removed_folder(spark, before)
    return last
