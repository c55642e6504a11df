"""Queries of the training-data operators over the driver's tables, with SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import filter_audit, importance, license_scan, line_join, mixing, passage_chains, piece_viterbi, projection_ann, quality_rules, simhash, suffix_dedup, token_output, toxicity
from .common import table


def op1(spark: SparkSession, d: str) -> DataFrame:
    return passage_chains.shared_passages(table(spark, d, "documents"))


def op2(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


def op3(spark: SparkSession, d: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, d, "documents"))


def op4(spark: SparkSession, d: str) -> DataFrame:
    return piece_viterbi.round_trip(table(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6(spark: SparkSession, d: str) -> DataFrame:
    return line_join.line_report(table(spark, d, "documents"))


def op7(spark: SparkSession, d: str) -> DataFrame:
    return suffix_dedup.repeated_substrings(table(spark, d, "documents")).drop("spans")


def op8(spark: SparkSession, d: str) -> DataFrame:
    return projection_ann.nearest(table(spark, d, "embeddings"))


def op9(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, d, "documents"))


def op10(spark: SparkSession, d: str) -> DataFrame:
    return token_output.encode_and_digest(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11(spark: SparkSession, d: str) -> DataFrame:
    return license_scan.license_report(table(spark, d, "documents"))


def op12(spark: SparkSession, d: str) -> DataFrame:
    return importance.resample(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op13(spark: SparkSession, d: str) -> DataFrame:
    return filter_audit.audit(table(spark, d, "documents"), table(spark, d, "labels"))


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


QUERIES = {
    "op1_substring_dedup": op1, "op2_toxicity": op2, "op3_quality_rules": op3, "op4_sentencepiece": op4, "op5_source_mixing": op5,
    "op6_line_dedup": op6, "op7_suffix_array_dedup": op7, "op8_nearest_neighbours": op8, "op9_simhash_near_dedup": op9, "op10_token_output": op10,
    "op11_license_scan": op11, "op12_importance_resampling": op12, "op13_filter_audit": op13, "pipeline": pipeline,
}
ORACLES = {"op3_quality_rules": quality_rules.ORACLE, "op5_source_mixing": mixing.ORACLE, "op11_license_scan": license_scan.ORACLE, "op12_importance_resampling": importance.ORACLE, "op13_filter_audit": filter_audit.ORACLE}
