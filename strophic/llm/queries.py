"""The registered queries of the training-data operators, each over its whole table with production settings."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cotraining, decontamination, fingerprints, katz, licenses, near_duplicates, packing, passages, quotations, token_files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.report(table(spark, sf_dir, "documents"))


def op3_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "start", "n_tokens", "ids_crc32", "file")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's path is its source, its language and its id."""
    return licenses.report(table(spark, sf_dir, "documents"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))


def op7_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"), cutoff=0)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.report(table(spark, sf_dir, "documents"))


def op10_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.link(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_cotraining, op2_superminhash, op3_canonical_digest, op4_token_files, op5_best_fit_packing, op6_license_scan, op7_katz_backoff, op8_benchmark_decontamination, op9_phrase_automata, op10_quotation_linking)}
ORACLE_SQL = {"op6_license_scan": licenses.oracle("concat_ws('/', source, lang, doc_id::VARCHAR)")}
