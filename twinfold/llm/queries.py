"""The registered queries of this package and the SQL twins of those that have one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (
    class_lm, decontaminate, language_id, license_scan, line_dedup, minhash_near, piece_codec, quality, resample, token_counts, token_output,
    vector_codes, vector_near,
)
from .common import table

ORACLE: dict[str, str] = {
    "op2_near_vectors": vector_near.OP2_SQL,
    "op6_license_scan": license_scan.op6_sql(),
    "op11_importance_resampling": resample.OP11_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
    "op13_line_dedup": line_dedup.OP13_SQL,
}


def op1_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.op1_decontaminate(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op2_near_vectors(spark: SparkSession, d: str) -> DataFrame:
    return vector_near.op2_near_vectors(table(spark, d, "embeddings"))


def op3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return piece_codec.op3_pieces(table(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_class_lm(spark: SparkSession, d: str) -> DataFrame:
    return class_lm.op4_class_lm(table(spark, d, "documents"))


def op5_token_output(spark: SparkSession, d: str) -> DataFrame:
    return token_output.op5_token_output(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return license_scan.op6_license_scan(table(spark, d, "documents"))


def op7_near_documents(spark: SparkSession, d: str) -> DataFrame:
    return minhash_near.op7_near_documents(table(spark, d, "documents"))


def op8_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_counts.op8_token_counts(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.op9_quality(table(spark, d, "documents"), table(spark, d, "labels"))


def op10_language_id(spark: SparkSession, d: str) -> DataFrame:
    return language_id.op10_language_id(table(spark, d, "documents"))


def op11_importance_resampling(spark: SparkSession, d: str) -> DataFrame:
    return resample.op11_importance_resampling(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op12_vector_codes(spark: SparkSession, d: str) -> DataFrame:
    return vector_codes.op12_vector_codes(table(spark, d, "embeddings"))


def op13_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return line_dedup.op13_line_dedup(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_near_vectors": op2_near_vectors,
    "op3_pieces": op3_pieces,
    "op4_class_lm": op4_class_lm,
    "op5_token_output": op5_token_output,
    "op6_license_scan": op6_license_scan,
    "op7_near_documents": op7_near_documents,
    "op8_token_counts": op8_token_counts,
    "op9_quality": op9_quality,
    "op10_language_id": op10_language_id,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_vector_codes": op12_vector_codes,
    "op13_line_dedup": op13_line_dedup,
}
