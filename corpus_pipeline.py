"""A corpus from raw documents to tokens, stage by stage.

Each stage takes all rows that its predecessor kept, is written as Parquet to shared storage and read
again, so a lost executor costs one stage's tasks at most. All stages but the last return the columns of
``documents``. Stages run with the operators' production parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterweave.llm import bpe, langid, lines, minhash, mixing
from rasterweave.llm.common import saved, shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letter, or a score below the least) go; without labels none does."""
    return langid.accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines close to an earlier line go; a document that loses all its lines is a copy of others and goes too."""
    return lines.deduplicated(docs, least=1, emptied=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id."""
    return minhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: rows repeat for further epochs or are left out beyond the budget."""
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, tokens."""
    return bpe.with_tokens(docs)


STAGES = [("language_id", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("encode", encode)]

#: A trained network and a tokenizer decide rows, which SQL can't express; a test holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), folder, f"{k}-{name}")
    return docs
