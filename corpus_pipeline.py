"""Corpus pipeline over documents: the stages in order, each a Parquet table that the next one reads.

Each stage works on all rows that the stage before kept. Null texts, and texts without a letter, go at the
first stage; from then on a stage drops or cuts what its operator decides and leaves everything else alone. Rows
without a doc_id are judged by their texts; repeated rows are one document, of which the second stage keeps one;
other columns may have any names; an empty table goes through all stages and packs nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm import decontaminate, jaccard, language_id, packing, suffix_dedup
from lumenfold.llm import shared as S


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the PPM models tell."""
    return language_id.accepted(docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of five-word shingle sets at a similarity of 0.8: that of the smallest doc_id."""
    return jaccard.one_of_each(docs)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that start earlier in the corpus."""
    return suffix_dedup.without_repeats(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language-id", keep_identified),
    ("jaccard-join", keep_one_of_near_duplicates),
    ("suffix-dedup", cut_repeated_strings),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: The stages learn models and cut byte strings, which SQL cannot express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = S.settle(stage(spark, docs, sf_dir), name)
    return docs
