"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bitsliced, brown_lm, language, line_dedup, mixing, packing, quality, secrets, simhash, token_counts, tokens
from .common import read_table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokens.default_tokenizer(), capacity=2048, eos=1)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.top_inner_products(read_table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit(docs))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(read_table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs, holdout=(4, 2)))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.judge(read_table(spark, sf_dir, "documents")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its text without later repeated runs of lines, and how many lines it had and lost."""
    return line_dedup.digest(read_table(spark, sf_dir, "documents"), run=50, gram=25)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), tokens.default_tokenizer(), limit=512)


def op10_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score_texts(read_table(spark, sf_dir, "documents"), units=1024, classes=64, holdout=(10, 0))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_topk, op3_secrets, op4_mixing, op5_language, op6_quality, op7_simhash, op8_line_dedup, op9_token_counts, op10_brown_lm)}


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": bitsliced.ORACLE}
