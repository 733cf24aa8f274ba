"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import brown, decontamination, langid, licenses, merkle, mixing, packing, quality, search, simhash, toolcalls, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op2_tool_calls(spark, sf_dir):
    return toolcalls.link(*toolcalls.every_call(table(spark, sf_dir, "conversations")), toolcalls.TURN_SCHEMAS)


def op3_brown_score(spark, sf_dir):
    return brown.score(table(spark, sf_dir, "documents"))


def op4_language_id(spark, sf_dir):
    return langid.predictions(table(spark, sf_dir, "documents"))


def op5_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("archive", "offset", "length")


def op6_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source", "budget")


def op7_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality(spark, sf_dir):
    return quality.rate(table(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontamination(spark, sf_dir):
    return decontamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark, sf_dir):
    return merkle.verify(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark, sf_dir):
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_packing(spark, sf_dir):
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Query]:
    every = (
        op1_license_scan, op2_tool_calls, op3_brown_score, op4_language_id, op5_warc, op6_mixing, op7_simhash, op8_quality, op9_toxicity, op10_decontamination,
        op11_merkle_manifest, op12_ranked_search, op13_packing,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the operator; the others are tested against brute force or held-out rows."""
    return {
        "op1_license_scan": licenses.oracle_sql(),
        "op2_tool_calls": toolcalls.ORACLE_SQL,
        "op5_warc": warc.ORACLE_SQL,
        "op6_mixing": mixing.MIX_SQL.format(docs="documents"),
        "op10_decontamination": decontamination.ORACLE_SQL,
        "op11_merkle_manifest": merkle.oracle_sql(),
        "op12_ranked_search": search.ORACLE_SQL,
    }
