"""The queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprint, forest, language, minhash, mixing, sql, suffix_dedup, token_counts, toxicity, url_filter
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    return importlib.import_module("public_tokenizers").path(name)


def op1_embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.classify(table(spark, sf_dir, "embeddings"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = importlib.import_module("public_tokenizers").PATTERN
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"), pattern)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.RULES, url_filter.labelled_urls(spark))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classify(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_embedding_neighbours": op1_embedding_neighbours,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_url_filter": op3_url_filter,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_fingerprints": op5_fingerprints,
        "op6_mixing": op6_mixing,
        "op7_minhash": op7_minhash,
        "op8_toxicity": op8_toxicity,
        "op9_token_counts": op9_token_counts,
        "op10_language_id": op10_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_neighbours": sql.OP1, "op4_suffix_dedup": sql.OP4, "op6_mixing": sql.OP6}
