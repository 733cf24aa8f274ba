"""Files: JSON lines, caches, summaries, sinks and the resumable stream."""

import json
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.operators import resume, samples
from rankloom.sources import documents, jsonl, results, versions
from rankloom.streaming import resume_log

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType())])


@pytest.fixture
def lines(tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "a", "n": 1}\n\n{"id": "b", "n": 2} tail\n{"id": "a", "n": 3}\nnot json\n{"id": "", "n": 4}\n')
    return str(tmp_path / "a.jsonl")


def test_bad_lines(spark, lines):
    assert sorted(r["n"] for r in jsonl.read(spark, lines, SCHEMA).collect()) == [1, 3, 4]
    kept = jsonl.read(spark, lines, SCHEMA, "keep")
    assert kept.count() == 5 and kept.filter(F.col(jsonl.BAD).isNotNull()).count() == 2
    with pytest.raises(Exception, match="not a JSON record"):
        jsonl.read(spark, lines, SCHEMA, "strict").collect()


def test_missing_file_is_empty_if_asked(spark, tmp_path):
    assert jsonl.read(spark, str(tmp_path / "none"), SCHEMA, missing_ok=True).count() == 0
    with pytest.raises(Exception):
        jsonl.read(spark, str(tmp_path / "none"), SCHEMA)


def test_last_wins_and_empty_keys_go(spark, lines):
    df = jsonl.last_wins(jsonl.read(spark, lines, SCHEMA), ["id"], [F.desc("n")])
    assert [tuple(r) for r in df.collect()] == [("a", 3)]


def test_shards_partition_the_input(spark):
    df = spark.range(10).withColumnRenamed("id", "i")
    assert sorted(r[0] for k in range(3) for r in jsonl.shard(df, "i", k, 3).collect()) == list(range(10))
    with pytest.raises(ValueError):
        jsonl.shard(df, "i", 3, 3)


def test_cache_shapes_and_override(spark, tmp_path):
    entry = {"output_text": "t", "parsed_ranking": [1], "recovered_business_ids": ["x"], "json_parse_ok": True, "output_tokens": 3}
    (tmp_path / "one.json").write_text(json.dumps({"backend": "m", "samples": [{"sample_id": "s", "positive_business_id": "p", **entry}]}))
    (tmp_path / "two.json").write_text(json.dumps({"samples": [{"sample_id": "s", "positive_business_id": None, "by_backend": {"m": {**entry, "output_text": "later"}, "k": entry}}]}))
    got = results.read_cache(spark, [str(tmp_path / "one.json"), str(tmp_path / "two.json")]).select("sample_id", "backend", "output_text", "positive_business_id").collect()
    assert sorted(map(tuple, got)) == [("s", "k", "t", "p"), ("s", "m", "later", "p")]


def test_summaries_prefer_the_student_and_count_zero_as_missing(spark, tmp_path):
    (tmp_path / "eval_a.json").write_text(json.dumps({"tag": "a", "n_samples": 7, "positive_metrics": {"teacher": {"recall@1": 0.1}, "student": {"recall@1": 1, "n_evaluated": 0}}}))
    (tmp_path / "eval_b.json").write_text(json.dumps({"tag": "b", "n_samples": 5, "positive_metrics": {"teacher": {"recall@1": 0.25}}}))
    got = results.read_summaries(spark, str(tmp_path / "eval_*.json")).select("tag", "n", F.col("`recall@1`")).orderBy("tag").collect()
    assert [tuple(r) for r in got] == [("a", 7, 1.0), ("b", 5, 0.25)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (0, "x")], "index int, v string")
    results.write_raw(df, str(tmp_path / "raw"))
    assert [json.loads(x[0]) for x in spark.read.text(str(tmp_path / "raw")).collect()] == [{"index": 0, "v": "x"}, {"index": 1, "v": None}]
    results.write_csv(df, str(tmp_path / "csv"))
    results.append(df, str(tmp_path / "log"))
    results.append(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    assert results.rewrite(df, str(tmp_path / "log"), "v2").endswith("log.v2")
    assert results.markdown(df).startswith("| index | v |")


def test_ordinals_have_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    got = samples.with_ordinal(df, ["k"]).orderBy("k").select("ordinal").collect()
    assert [r[0] for r in got] == list(range(1000))


def test_stride_of_283(spark):
    df = samples.stride(spark.range(283).withColumnRenamed("id", "o"), "o", 5)
    assert sorted(r[0] for r in df.collect()) == [0, 56, 112, 168, 224]
    assert samples.stride(spark.range(3).withColumnRenamed("id", "o"), "o", 0).count() == 0


def test_pending_ignores_errors(spark):
    todo = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    log = spark.createDataFrame([("a", None), ("b", "timeout")], "id string, error string")
    assert sorted(r[0] for r in resume.pending(todo, log, ["id"]).collect()) == ["b", "c"]


STREAM = T.StructType([T.StructField("sample_id", T.StringType()), T.StructField("error", T.StringType()), T.StructField("text", T.StringType())])


def stream(spark, path, **more):
    (path / "in").mkdir(exist_ok=True)

    def run(name=None, *rows):
        if name:
            (path / f"in/{name}.json").write_text("".join(json.dumps(dict(zip(("sample_id", "error", "text"), r, strict=True))) + "\n" for r in rows))
        resume_log.append_pending(resume_log.source(spark, str(path / "in"), STREAM), str(path / "log"), ["sample_id"], str(path / "cp"), **more).awaitTermination()
        return sorted((r["sample_id"] or "", r["error"] or "", r["text"] or "") for r in resume_log.records(spark, str(path / "log"), STREAM).collect())

    return run


def test_stream_keeps_every_success(spark, tmp_path):
    run = stream(spark, tmp_path, order=["text"])
    first = run("1", ("a", "x", "1"), ("a", None, "2"), ("b", "x", "1"), ("b", "y", "2"), (None, None, "0"), ("d", None, "2"), ("d", None, "1"))
    assert first == [("", "", "0"), ("a", "", "2"), ("b", "y", "2"), ("d", "", "1")]
    second = run("2", ("a", "late", "3"), ("a", None, "4"), ("b", "y", "5"), ("c", "z", "1"))
    assert second == sorted([*first, ("c", "z", "1")])  # a has succeeded, the error of b is known
    assert run("3", ("b", None, "6"), ("c", "z2", "2")) == sorted([*second, ("b", "", "6"), ("c", "z2", "2")])
    done = resume_log.succeeded(resume_log.records(spark, str(tmp_path / "log"), STREAM), ["sample_id"])
    assert {r[0] for r in done.collect()} == {None, "a", "b", "d"}


def test_stream_batch_that_runs_again_adds_nothing(spark, tmp_path):
    run = stream(spark, tmp_path)
    run("1", ("a", None, "1"), ("b", "x", "1"))
    want = run("2", ("a", None, "2"), ("b", None, "2"), ("c", "x", "1"))
    for f in (tmp_path / "cp/commits").iterdir():  # as if the driver had gone between writing and committing the last batch
        if f.name.strip(".").startswith("1"):
            f.unlink()
    assert run() == want
    assert run("3", ("c", None, "2"))[-1] == ("c", "x", "1") and len(run()) == len(want) + 1


def test_stream_forgets_in_time_and_knows_an_older_log(spark, tmp_path):
    older = spark.createDataFrame([("a",)], "sample_id string")
    run = stream(spark, tmp_path, memory_ms=4000, finished=older)
    assert run("1", ("a", None, "1"), ("b", None, "1")) == [("b", "", "1")]
    time.sleep(6)
    assert run("2", ("b", None, "2")) == [("b", "", "1"), ("b", "", "2")]  # b is new again


def test_versions_swap_in_one_step(spark, tmp_path, monkeypatch):
    """A reader, and a crash between any two steps, sees the old table or the new one."""
    table = str(tmp_path / "table")
    with pytest.raises(ValueError, match="no version"):
        versions.current(spark, table)
    versions.publish(spark.range(3), table, "one")
    held = versions.current(spark, table)
    versions.publish(held.selectExpr("id + 10 AS id"), table, "two")  # from the table itself
    ids = lambda df: sorted(r[0] for r in df.collect())
    assert ids(held) == [0, 1, 2] and ids(versions.current(spark, table)) == [10, 11, 12] and versions.before(spark, table) == "one"

    def crash(*_):
        raise OSError("gone")

    for step in ("_write", "_move_over"):
        with monkeypatch.context() as m:
            m.setattr(versions, step, crash)
            with pytest.raises(OSError):
                versions.publish(spark.range(99), table, f"lost{step}")
        assert ids(versions.current(spark, table)) == [10, 11, 12]
    with pytest.raises(ValueError, match="already"):
        versions.publish(spark.range(1), table, "two")
    assert set(versions.prune(spark, table, keep=0)) == {"one", "lost_write", "lost_move_over"}
    assert ids(versions.current(spark, table)) == [10, 11, 12] and [p.name for p in (tmp_path / "table").iterdir() if p.name.startswith("_next")] == []
    assert ids(versions.at_version(spark, table, "two")) == [10, 11, 12]


def test_documents_are_split_anywhere(spark, tmp_path, monkeypatch):
    """Strings with braces, quotes and backslashes, other arrays beside the one, arrays in objects; ranges of a few bytes."""
    nasty = ['}{"samples": [', 'back\\slash\\', 'quote " } ] [', "é}\n\t", "\\", '\\"}', ""]
    rows = [{"i": i, "t": nasty[i % len(nasty)], "in": {"list": [{"x": [i]}, "}"], "samples": [{"a": 1}]}} for i in range(14)]
    texts = {
        "a": json.dumps({"meta": {"samples": [{"no": 1}]}, "note": '"samples": [{', "samples": rows, "other": [{"y": 1}, {"z": "}"}], "n": 2}, ensure_ascii=False) + "\n",
        "b": json.dumps({"samples": rows[:7]}, indent=2), "c": '{"samples": [ ], "k": {"a": 1}}', "d": '{"x": {"samples": [{}]}}',
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for size in ("150b", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            elements, shells = documents.split(spark, [str(tmp_path / f"{n}.json") for n in texts], "samples")
            got = {}
            for r in elements.orderBy("place").collect():
                got.setdefault(r["path"][-6], []).append(json.loads(r["element"]))
            assert got == {"a": rows, "b": rows[:7]}
            shell = {r["path"][-6]: r["shell"] and json.loads(r["shell"]) for r in shells.collect()}
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
        assert shell == {"a": {**json.loads(texts["a"]), "samples": []}, "b": {"samples": []}, "c": {"samples": [], "k": {"a": 1}}, "d": None}


def test_split_caches_have_the_same_rows(spark, tmp_path):
    entry = lambda i: {"output_text": f"}}{i}\"", "parsed_ranking": [2, 1], "recovered_business_ids": ["a", "b"], "json_parse_ok": True, "output_tokens": i}
    one = {"backend": "m1", "samples": [{"sample_id": f"s{i}", "positive_business_id": "a", **entry(i)} for i in range(30)]}
    two = {"samples": [{"sample_id": f"s{i}", "positive_business_id": None, "by_backend": {"m1": entry(100 + i), "m2": entry(i)}} for i in range(20, 40)]}
    for name, x in (("one", one), ("two", two)):
        (tmp_path / f"{name}.json").write_text(json.dumps(x))
    paths = [str(tmp_path / "one.json"), str(tmp_path / "two.json")]
    rows = lambda split: sorted(map(str, results.read_cache(spark, paths, split).collect()))
    assert rows(True) == rows(False) == rows(None) and len(rows(True)) == 60
    (tmp_path / "two.json").write_text('{"backend": "x"}')
    with pytest.raises(ValueError, match="without samples"):
        results.read_cache(spark, paths, split=True)
