"""A training corpus from raw documents, in five stages.

Each stage takes what the one before it kept, written as Parquet and read
again: quality rules, language identification, near-duplicates, benchmark
decontamination, and the mix of sources.  Null and empty texts fail the quality
rules; rows that repeat are told apart by no stage but the third, which keeps
one; other columns may have any name; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import decontamination, langid, mixing, quality, similar
from rankloom.llm.common import Staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that this input's own labels teach."""
    return langid.known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash links, and texts of five-word similarity 0.8 or more."""
    return similar.dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with their number of words and how many of them it takes, repeats counted; documents of which it takes none go."""
    return mixing.mixed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
]

#: Suffix arrays, kernels and fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage wrote goes once the next one has written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        after = Staged(stage(spark, docs, sf_dir), name)
        if before is not None:
            before.drop()
        docs, before = after.df, after
    return STAGES[-1][1](spark, docs, sf_dir)
