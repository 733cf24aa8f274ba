"""Text, parsing and statistics on small inputs."""

import json
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions import parsing, schemas, stats, text
from rankloom.operators import judge, order_stats, samples


def test_chi_square_tail_of_recorded_counts():
    # 369.9631 on 9 degrees is the recorded statistic of 2,953 rankings
    assert stats.chi2_tail(369.9631, 9) == pytest.approx(3.47609e-74, rel=1e-3)
    assert stats.chi2_tail(8.9, 9) == pytest.approx(0.446556, abs=1e-5)
    assert stats.chi2_tail(12.3794, 9) == pytest.approx(0.192754, abs=1e-5)
    assert stats.chi2_tail(4.0, 2) == pytest.approx(math.exp(-2))
    assert math.isnan(stats.chi2_tail(math.nan, 9))


def test_correlation_tail():
    assert stats.correlation_tail(0.0, 10) == 1.0
    assert stats.correlation_tail(0.5, 10) == pytest.approx(0.141111, abs=1e-5)  # t = 1.633 with 8 degrees
    assert math.isnan(stats.correlation_tail(0.5, 2))


@pytest.mark.parametrize(("raw", "want"), [
    ('{"ranking": [2, 1]}', [2, 1]), ('so: {"ranking": [2, 1]} indeed', [2, 1]), ('```json\n{"ranking": [2, 1]}\n```', [2, 1]), ('{"ranking": [2, 1', None),
    ('{"ranking": [1, 1]}', None), ('{"ranking": [1, 99]}', None), ('{"ranking": [1]}', None), ('{"ranking": ["two", 1]}', None), ('{"ranking": [true, 2]}', None),
    ("} before", None), (None, None), ("", None)])
def test_ranking_in_noise(raw, want):
    assert parsing.ranking_in(parsing.json_object(raw), 2) == want


@pytest.mark.parametrize("seed", range(7))
def test_derangement(seed):
    items = list("abcdefghij")
    out = parsing.shuffled(items, seed, fixed_points=False)
    assert sorted(out) == items
    assert all(a != b for a, b in zip(out, items, strict=True))
    assert parsing.shuffled([1, 2], seed) == [2, 1]
    assert parsing.shuffled(["x", "x"], seed, fixed_points=False) == ["x", "x"]


def test_half_even_percentile(spark):
    df = spark.range(1, 101).select(F.lit("g").alias("g"), F.col("id").alias("v"))
    row = order_stats.pick(df, ["g"], "v", {"p2": order_stats.half_even(0.5), "p1": order_stats.nearest_rank(50), "p4": order_stats.floored(0.5)}).first()
    assert (row["p2"], row["p1"], row["p4"]) == (51, 50, 51)


def test_snippet(spark):
    rows = [(None,), ("",), (" a  b\n c ",), ("x" * 199 + " y" + "z" * 10,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(text.snippet(F.col("t"))).collect()]
    assert got == ["", "", "a b c", "x" * 199 + "…"]


def test_ties_of_printed_numbers_go_to_even(spark):
    got = spark.createDataFrame([(2.5, 4.25), (3.5, 1234.75), (None, None)], "a double, b double").select(text.fixed(F.col("a"), 0), text.fixed(F.col("b"), 1)).collect()
    assert [tuple(r) for r in got] == [("2", "4.2"), ("4", "1234.8"), ("?", "?")]


def test_coerce_leaves_other_text_out(spark):
    df = spark.createDataFrame([(["3", "1", "b1", "12345678901", "9" * 30, "-1"],)], "r array<string>")
    assert df.select(text.coerce_indices(F.col("r"))).first()[0] == [3, 1, None, 12345678901, None, None]


def test_hash_split_holds_its_ratio(spark):
    n = spark.range(1000).filter(samples.in_train(F.concat(F.lit("s"), F.col("id").cast("string")))).count()
    assert 850 < n < 950


def test_point_biserial_guards(spark):
    df = spark.createDataFrame([("few", 1.0, 0.0), ("few", 2.0, 1.0), ("flat", 1.0, 0.0), ("flat", 1.0, 1.0), ("flat", 1.0, 1.0)], "g string, x double, y double")
    got = {r["g"]: r["r"] for r in df.groupBy("g").agg(judge.correlation(F.col("x"), F.col("y")).alias("r")).collect()}
    assert all(map(math.isnan, got.values()))


@pytest.mark.parametrize(("values", "want"), [((-2.0, -3.0, -1.0, -1.0), "pass"), ((-0.5, -0.9, -0.1, -1.0), "weak"), ((-0.5, -1.0, 0.5, -1.0), "null"), ((1.0, 0.5, 1.5, -1.0), "inverted"), ((0.0, -0.5, 0.5, 0.0), "consistent"), ((-1.0, -1.5, -0.5, 0.0), "unexpected-drop"), ((math.nan, 0.0, 0.0, 0.0), "insufficient")])
def test_probe_labels(spark, values, want):
    df = spark.createDataFrame([values], "m double, l double, h double, e double")
    assert df.select(judge.probe_label(*map(F.col, "mlhe"))).first()[0] == want


def test_wilcoxon_against_pairs(spark):
    d = [3.0, -1.0, -2.0, -2.0, 0.0, -5.0]
    row = judge.wilcoxon(spark.createDataFrame([("k", x) for x in d], "k string, value double"), ["k"]).first()
    assert (row["n_total"], row["n_effective"], row["statistic"]) == (6, 5, 4.0)
    zeros = judge.wilcoxon(spark.createDataFrame([("k", 0.0)], "k string, value double"), ["k"]).first()
    assert zeros["error"].startswith("all deltas") and zeros["z"] is None


def test_pretty_json_keeps_order(spark):
    raw = json.dumps({"b": 1, "a": ["é"]})
    assert spark.createDataFrame([(raw,)], "t string").select(parsing.pretty_json("t")).first()[0] == '{\n  "b": 1,\n  "a": [\n    "é"\n  ]\n}'


# --- schemas as patterns ---


@pytest.mark.parametrize(("low", "high"), [(None, None), (1, 10), (0, 0), (7, 7), (95, 1203), (100, 999), (-5, 3), (-120, -17), (None, -3), (None, 42), (38, None), (-12, None), (0, None), (1000, 99999)])
def test_integer_patterns(low, high):
    p = re.compile(schemas.integers(low, high) + r"\Z")
    for n in {*range(-1300, 1300), *(10**k + d for k in range(2, 8) for d in (-1, 0, 1)), *(-(10**k) + d for k in range(2, 8) for d in (-1, 0, 1))}:
        assert bool(p.match(str(n))) == ((low is None or n >= low) and (high is None or n <= high)), n
    assert not p.match("01") and not p.match("+1") and not p.match("")


def test_patterns_of_schemas(spark):
    schema = {"type": "object", "properties": {"kind": {"enum": ["a.b", "c|d", 3, None]}, "n": {"type": ["integer", "null"], "minimum": 2}, "list": {"type": "array", "items": {"type": "string", "maxLength": 3}, "minItems": 1, "maxItems": 2}, "x": {"type": "number"}, "ok": {"type": "boolean"}}}
    good = [
        '{"kind": "a.b", "n": 2, "list": ["abc"], "x": -1.5e3, "ok": true}', ' {"kind":null,"n":null,"list":["","\\u00e9\\n"],"x":0,"ok":false}\n',
        '{\n "kind" : 3 , "n" : 17 , "list" : [ "é" , "\\"" ] , "x" : 12.0 , "ok" : true }',
    ]
    bad = ['{"kind": "aXb", "n": 2, "list": ["a"], "x": 1, "ok": true}', good[0].replace("2", "1"), good[0].replace('["abc"]', "[]"), good[0].replace('["abc"]', '["a","b","c"]'), good[0].replace('"abc"', '"abcd"'), good[0].replace("-1.5e3", "01"), good[0] + "x", good[0].replace('"n": 2, ', ""), good[0].replace("true", "True")]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(good + bad)], "i int, s string")
    assert [r[0] for r in rows.orderBy("i").select(F.col("s").rlike(schemas.whole(schema))).collect()] == [True] * len(good) + [False] * len(bad)
    assert re.search(schemas.whole(schemas.ranking_schema(3)).replace(r"\z", r"\Z"), '{"persona": "p", "rationales": [{"candidate_index": 1, "reason": "r"}, {"candidate_index": 2, "reason": ""}, {"candidate_index": 3, "reason": "x"}], "ranking": [3, 1, 2]}')
    for wrong in ({"type": "string", "pattern": "a"}, {"type": "array"}, {"type": "object", "properties": {"a": {"type": "null"}}, "required": []}, {"oneOf": []}, {"type": "number", "minimum": 1}, {"type": "integer", "minimum": 3, "maximum": 2}):
        with pytest.raises(ValueError):
            schemas.pattern(wrong)
