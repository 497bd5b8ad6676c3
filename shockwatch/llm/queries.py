"""Registered queries of the training-data operators: ``opN_<name>`` and the pipeline."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import ann, exact, extract, licenses, merkle, mixing, packing, quality, simhash, token_files, tokens, warc, whitening
from .common import table

#: Folder of the public tokenizer files; by default the one of the installed package.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "")


def tokenizer(name: str) -> str:
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, k=20)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), 4096, 1)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"), distance=2, size=3)


def op5_mincut_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), revisit_from=0)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), 4096)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup_report(table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_report(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)


QUERIES = {f.__name__: f for f in (
    op1_attention_quality, op2_posting_lists, op3_best_fit_packing, op4_simhash_near_dedup, op5_mincut_extraction,
    op6_license_scan, op7_warc_zstd, op8_token_counts, op9_exact_dedup, op10_source_mixing, op11_merkle_manifest,
    op12_whitening, op13_token_files)}
ORACLE = {"op6_license_scan": licenses.oracle_sql(), "op7_warc_zstd": warc.ORACLE_SQL, "op9_exact_dedup": exact.ORACLE_SQL,
          "op11_merkle_manifest": merkle.ORACLE_SQL}
