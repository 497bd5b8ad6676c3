"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Null texts and ids, empty tables, repeated rows and extra columns are handled as the operators
define them; every stage but the last returns the columns it was given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shockwatch.llm import exact, mixing, packing, quality, simhash
from shockwatch.llm.common import store, table
from shockwatch.llm.queries import tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact.deduplicate(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the row with the smallest doc_id stays."""
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights: a row per copy taken."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture as sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), 4096, 1)


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("SimHash near-dedup", simhash_stage),
          ("mixing to target weights", mixing_stage), ("best-fit packing", packing_stage)]

#: SQL cannot express the trained classifier, the linked fingerprints, the dual solver or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{at}")
    return docs
