"""A corpus pipeline: from raw documents to the encoded training set.

Each stage takes ``(spark, docs, sf_dir)`` and returns what it keeps, with the
columns of ``documents``; the last returns one row of encoding per document. A
stage's result is written and read back before the next one starts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from twinfold.llm import decontaminate, language_id, minhash_near, piece_codec, quality
from twinfold.llm.common import Scratch, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_near.keep_first(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_codec.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", known_language),
    ("quality", good_quality),
    ("minhash_near", near_copies),
    ("decontaminate", no_benchmark),
    ("pieces", pieces),
]

ORACLE_SQL = None  # learned filters, compressed sizes and tokenizers are beyond SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and reread."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        kept = scratch.write(stage(spark, docs, sf_dir))
        if name != STAGES[0][0]:
            scratch.drop(docs)
        docs = kept
    return docs
