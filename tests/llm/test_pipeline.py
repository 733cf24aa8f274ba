"""The pipeline's stages against brute force, each on its own input."""

import corpus_pipeline
import pytest
from test_models import brute_cover, plain_groups

from rankloom.llm import decontamination, mixing
from rankloom.llm.common import words_of


def test_stages_one_by_one(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        rows = {r["doc_id"]: r for r in out.collect()}
        if k < 4:
            assert out.columns == names and all(rows[i] == before[i] for i in rows)
        if name == "quality_rules":
            clean = {i for i, r in before.items() if len(w := words_of(r["text"])) >= 20 and 100 * len(brute_cover(w)) <= 30 * len(w)}
            assert set(rows) <= clean and len(rows) >= 0.99 * len(clean)
        elif name == "language_id":
            assert len(rows) >= 0.99 * len(before)
        elif name == "near_duplicates":
            assert set(rows) == plain_groups([(i, r["text"]) for i, r in before.items()])
        elif name == "benchmark_decontamination":
            dirty = {r["doc_id"] for r in decontamination.contained(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
            assert dirty and set(rows) == set(before) - dirty
        else:
            assert sum(r["taken"] for r in rows.values()) == pytest.approx(sum(len(words_of(r["text"])) for r in before.values()), abs=len(mixing.WEIGHTS) * 20)
            assert all(0 < r["taken"] <= 3 * r["size"] for r in rows.values())
            assert out.columns == [*names, "size", "taken"] and all(r["text"] == before[i]["text"] for i, r in rows.items())
        docs, before = out, rows
    again = {r["doc_id"]: r["taken"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert again == {i: r["taken"] for i, r in before.items()}


def test_empty_input(spark, sf_dir, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_odd_input(spark, sf_dir, odd_docs):
    """Each stage on nulls, empty and long texts, repeated rows, and columns named as the operators name theirs."""
    odd = odd_docs.selectExpr("*", "1 AS __lost", "2 AS __twice", "3 AS __dirty", "4 AS __key", "5 AS __source", "6 AS __nth")
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf_dir)
        assert out.columns[: len(odd.columns)] == odd.columns
        got[name] = sorted(str(r["doc_id"]) for r in out.collect())
    every = sorted(str(r["doc_id"]) for r in odd.collect())
    assert got["quality_rules"] == ["5"]
    assert set(got["language_id"]) <= {"1", "5", "6", "None"} and got["language_id"].count("None") <= 1
    assert got["near_duplicates"] == sorted(["1", "2", "5", "6", "7", "None", "None"])
    assert got["benchmark_decontamination"] == every  # none holds an item
    assert got["source_mix"] == sorted(str(r["doc_id"]) for r in mixing.mix(odd).filter("taken > 0").collect())
