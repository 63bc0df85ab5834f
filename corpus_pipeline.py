"""A training corpus from raw documents: five stages, each over all that the stage before kept.

Nulls in any column, empty and very long texts, ties, repeated rows and empty
tables go through all stages as the operators' docstrings say; columns beyond
those of documents are carried along to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import language, line_dedup, mixing, packing, simhash, tokens
from graphloom.llm.common import drop_scratch, materialize, read_table, temporary_tables


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones too), or without a language that holds 0.4 of the posterior, go. Extra columns stay."""
    return language.keep_identified(docs, language.fit(docs), least=0.4)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that occur earlier are cut from the texts; all documents stay, those with nothing left as well."""
    out = line_dedup.dedup_lines(docs, run=50, gram=25)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard similarity 0.8 or more of 5-word shingles) stays: that of the smallest doc_id; of equal rows one."""
    return simhash.keep_representatives(docs, shingle=5, radius=78, least=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources reach their shares of the words."""
    return mixing.expand(docs, weights=(5, 2, 1), most=3)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 2048; a repeated document is packed as often as it is taken."""
    return packing.pack_documents(docs, tokens.default_tokenizer(), capacity=2048, eos=1)


STAGES = [("language_id", language_id), ("line_dedup", dedup_lines), ("near_dedup", near_dedup), ("mixing", mix_sources), ("packing", pack)]

#: SQL cannot express the stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's table goes once the next one's is written."""
    docs, own = read_table(spark, sf_dir, "documents"), False
    for name, stage in STAGES[:-1]:
        with temporary_tables(spark):
            after = materialize(stage(spark, docs, sf_dir), name, outlives=True)
        if own:
            drop_scratch(docs)
        docs, own = after, True
    packed = STAGES[-1][1](spark, docs, sf_dir)  # packing has read docs when it returns
    drop_scratch(docs)
    return packed
