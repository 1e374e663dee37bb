"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes all rows its predecessor kept. Documents of no known language go; repeated lines go
from the documents they repeat in; one document of each near-duplicate group stays; documents that
hold a benchmark item go; what remains is encoded. All stages but the last keep the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfline.llm import decontaminate, language, line_dedup, near_dedup, pieces
from shelfline.llm.common import table, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs)


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.keep_first_lines(spark, docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(spark, docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(spark, docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(spark, docs).select("doc_id", "token_ids", "n_tokens")


STAGES = [
    ("language_id", known_language),
    ("line_dedup", first_lines),
    ("simhash_near_dedup", one_of_each),
    ("decontamination", without_benchmark),
    ("sentencepiece", token_ids),
]

#: Trained profiles, SimHashes and piece tables have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
