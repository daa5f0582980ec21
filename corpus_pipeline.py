"""The corpus pipeline: documents in, packed training sequences out.

Every stage reads what its predecessor kept, written as Parquet. The first two and the fourth drop rows
(rejected by the quality rules, near copies of an earlier document, contaminated by the benchmark), the
third cuts repeated strings from texts, the last gives a row per packed piece.

Defined cases follow from the operators: null, empty and other texts of under 50 words fail the base rule of the
first stage; long texts are judged and cut whole; of repeated rows and of rows that share a set one stays, the one with
the least key; rows without a key are not near duplicates of any. Empty tables give no rows. The first four stages return the
columns of ``documents``, whatever others are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strikebook.llm import best_fit, decontaminate, ngram_join, quality_rules, suffix_dedup
from strikebook.llm.shared import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the proven cutoffs keep."""
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id."""
    return ngram_join.keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without strings of 100 bytes or more that stand earlier in the corpus."""
    return suffix_dedup.reduced(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated."""
    return decontaminate.keep(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return best_fit.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_strings),
    ("benchmark_decontamination", clean_of_benchmark),
    ("best_fit_packing", packed),
]

#: The packing has no SQL form; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
