"""Operators on inputs that the tables don't hold: large groups, logs with repeats, odd texts, missing parts."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom import reports
from rankloom.functions import parsing, ranks, text
from rankloom.operators import bias, judge, merging, order_stats, perturb, resume, samples, validation
from rankloom.sources import results


# --- ranks and percentiles ----------------------------------------------------------


def test_ordinals_of_a_large_table_with_other_columns(spark):
    n = 1_500_000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.md5(F.col("id").cast("string")).alias("other"), (F.col("id") % 2).alias("__part0"))
    row = samples.with_ordinal(df, ["k"]).agg(F.count("*"), F.count_distinct("ordinal"), F.min("ordinal"), F.max("ordinal"), F.count(F.when(F.col("ordinal") == F.col("k"), 1))).first()
    assert tuple(row) == (n, n, 0, n - 1, n)


def test_percentiles_of_a_group_beyond_its_sketch(spark):
    n = 300_000
    heavy = F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(F.pow(F.rand(3), 4) * 1000)  # a third of all rows ties
    df = spark.range(n).select(F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise("g").alias("g"), heavy.alias("v")).unionByName(spark.createDataFrame([("few", 2.0), ("few", 1.0), ("few", None), ("none", None)], "g string, v double")).cache()
    places = {"p1": order_stats.nearest_rank(99.9), "p2": order_stats.half_even(0.5), "p4": order_stats.floored(0.95)}
    got = {r["g"]: r for r in order_stats.pick(df, ["g"], "v", places).collect()}
    lin = {r["g"]: r for r in order_stats.quantiles(df, ["g"], "v", {"q": 0.95, "m": 0.5}).collect()}
    rows = df.filter("v IS NOT NULL").toPandas()
    for g in ("g", None, "few"):
        v = np.sort(rows[rows["g"].isna() if g is None else rows["g"] == g]["v"].to_numpy())
        k = len(v)
        assert got[g]["n"] == k
        assert got[g]["p1"] == v[min(k, max(1, math.floor(99.9 / 100 * k + 0.999999))) - 1]
        assert got[g]["p2"] == v[round(0.5 * (k - 1))] and got[g]["p4"] == v[min(k - 1, int(0.95 * k))]
        assert lin[g]["q"] == pytest.approx(np.percentile(v, 95)) and lin[g]["m"] == pytest.approx(np.percentile(v, 50))
    assert set(got) == {"g", None, "few"}
    assert order_stats.pick(df.limit(0), ["g"], "v", places).count() == 0
    whole = order_stats.pick(df, [], "v", {"m": order_stats.half_even(0.5)}).first()
    assert whole["m"] == np.sort(rows["v"].to_numpy())[round(0.5 * (len(rows) - 1))]


def test_average_ranks_with_ties(spark):
    v = [3.0, 1.0, 3.0, 2.0, 3.0, 1.0]
    got = judge.average_ranks(spark.createDataFrame([("k", x) for x in v], "k string, v double"), ["k"], "v", "r").collect()
    assert sorted((r["v"], r["r"]) for r in got) == [(1.0, 1.5), (1.0, 1.5), (2.0, 3.0), (3.0, 5.0), (3.0, 5.0), (3.0, 5.0)]


# --- verdicts -----------------------------------------------------------------------


def test_last_clean_verdict_of_an_arm_counts(spark):
    rows = [("s", "base", 1, 5, None, 3, None), ("s", "base", 2, 7, None, 3, None), ("s", "base", 3, 1, None, 3, "timeout"), ("s", "p1", 4, 4, 2, 2, None), ("s", "p1", 9, 6, None, 1, None), ("t", "base", 5, 5, 5, 5, None), ("", "base", 1, 1, 1, 1, None), ("", "p1", 1, 1, 1, 1, None), (None, "base", 1, 1, 1, 1, None)]
    v = spark.createDataFrame(rows, "sample_id string, arm string, line long, groundedness long, personalization long, ranking_coherence long, error string")
    got = judge.deltas(judge.pairs(v, "sample_id", "arm", "base", ["p1", "p2"], ["line"]), ["sample_id"]).collect()
    assert sorted((r["sample_id"], r["probe"], r["axis"], r["value"]) for r in got) == [("s", "p1", "groundedness", -1.0), ("s", "p1", "ranking_coherence", -2.0)]


def test_models_without_tag_or_axis(spark):
    rows = [("m", 4, None, None), ("m", 6, None, None), ("m", None, None, "x"), (None, 3, 2, None), ("", 5, 2, None), ("bad", None, None, "x")]
    v = spark.createDataFrame([(t, g, g, r, e) for t, g, r, e in rows], "model_tag string, groundedness long, personalization long, ranking_coherence long, error string")
    got = {(r["model_tag"], r["axis"]): r for r in judge.per_model(v).collect()}
    assert {t for t, _ in got} == {"m", "unknown", "bad"} and len(got) == 9
    m = got["m", "groundedness"]
    assert (m["n_total"], m["n_scored"], m["n_errors"], m["n"], m["mean"]) == (3, 2, 1, 2, 5.0) and 4 <= m["low"] <= 5 <= m["high"] <= 6
    assert got["unknown", "ranking_coherence"]["mean"] == 2.0 and got["m", "ranking_coherence"]["n"] == 0 and math.isnan(got["bad", "groundedness"]["mean"])


def test_bootstrap_is_one_law_at_every_size(spark):
    """Cells and trees of any shape, and resampling by rows, agree within their noise."""
    values = np.random.default_rng(1).gamma(2.0, 3.0, 900)
    df = spark.createDataFrame([("a", float(x)) for x in values] + [(None, 1.0), (None, None)], "k string, value double")
    rng = np.random.default_rng(0)
    means = values[rng.integers(0, 900, (10_000, 900))].mean(axis=1)
    low, high = np.quantile(means, [0.025, 0.975])
    for cell, fanout in ((4096, 256), (100, 4), (7, 200)):
        got = {r["k"]: r for r in judge.bootstrap(df, ["k"], cell=cell, fanout=fanout).collect()}
        assert set(got) == {"a", None} and got["a"]["n"] == 900 and got["a"]["mean"] == pytest.approx(values.mean())
        assert abs(got["a"]["low"] - low) < 0.04 * (high - low) and abs(got["a"]["high"] - high) < 0.04 * (high - low)
        assert got[None]["n"] == 1 and got[None]["low"] == got[None]["high"] == 1.0
    again = judge.bootstrap(df.repartition(7), ["k"], cell=100, fanout=4).filter("k = 'a'").first()
    assert (again["low"], again["high"]) == tuple(judge.bootstrap(df, ["k"], cell=100, fanout=4).filter("k = 'a'").first()[c] for c in ("low", "high"))
    assert judge.bootstrap(df.limit(0), ["k"]).count() == 0 and judge.bootstrap(df, [], resamples=500).first()["n"] == 901


def test_bootstrap_of_a_million_skewed_values(spark):
    df = spark.range(1_000_000).selectExpr("'k' AS k", "exp(1.5 * sqrt(-2 * ln(rand(3))) * cos(2 * pi() * rand(4))) AS value")
    df = df.cache()
    got = judge.bootstrap(df, ["k"], resamples=300).first()
    v = df.select("value").toPandas()["value"].to_numpy()
    rng = np.random.default_rng(5)
    low, high = np.quantile([v[rng.integers(0, len(v), len(v))].mean() for _ in range(300)], [0.025, 0.975])
    assert abs(got["low"] - low) < 0.15 * (high - low) and abs(got["high"] - high) < 0.15 * (high - low)
    df.unpersist()


def test_ranks_of_null_groups(spark):
    df = spark.createDataFrame([(None, 3.0, 1.0), (None, -4.0, 2.0), (None, 3.0, 5.0), ("k", 1.0, 1.0), ("k", None, 2.0)], "k string, value double, other double")
    assert sorted((r["value"], r["r"]) for r in judge.average_ranks(df.filter("k IS NULL"), ["k"], "value", "r").collect()) == [(-4.0, 1.0), (3.0, 2.5), (3.0, 2.5)]
    w = {r["k"]: r for r in judge.wilcoxon(df, ["k"]).collect()}
    assert (w[None]["n_total"], w[None]["n_effective"], w[None]["statistic"], w[None]["error"]) == (3, 3, 3.0, None)
    assert w["k"]["n_effective"] == 1 and w["k"]["p_value"] is None and w["k"]["error"].startswith("fewer")
    rho = {r["k"]: r for r in judge.rank_correlation(df, ["k"], {"rho": ("value", "other")}).collect()}
    assert rho[None]["rho_n"] == 3 and rho[None]["rho"] == pytest.approx(0.0) and math.isnan(rho["k"]["rho"])


def test_signed_ranks_exact_and_beyond(spark):
    """Golden values of the reports: 49 drops and none; one pair of 50 that rises; brute force over all signs."""
    from itertools import product

    from rankloom.functions import stats

    for n in (2, 5, 9):
        sums = [sum(r for r, s in zip(range(1, n + 1), signs, strict=True) if s) for signs in product((0, 1), repeat=n)]
        assert all(stats.signed_rank_tail(w, n) == pytest.approx(sum(s <= w for s in sums) / 2**n) for w in range(n * (n + 1) // 2 + 1))
    rng = np.random.default_rng(2)
    untied = [("u", float((-1) ** int(x < 0.7) * (i + 1))) for i, x in enumerate(rng.random(30))]
    tied = [("t", float((-1) ** int(x < 0.7) * (i // 2 + 1))) for i, x in enumerate(rng.random(30))]
    many = [("m", float((-1) ** int(x < 0.6) * (i + 1))) for i, x in enumerate(rng.random(51))]
    got = {r["k"]: r for r in judge.wilcoxon(spark.createDataFrame(untied + tied + many, "k string, value double"), ["k"]).collect()}
    assert got["u"]["p_value"] == pytest.approx(stats.signed_rank_tail(sum(i + 1 for i, (_, x) in enumerate(untied) if x > 0), 30), rel=1e-12)
    for k in "tm":
        assert got[k]["p_value"] == pytest.approx(1 - stats.normal_tail(got[k]["z"]))
    drops = [("d", -float(x)) for x in rng.integers(5, 10, 49)] + [("d", 0.0)]
    row = judge.wilcoxon(spark.createDataFrame(drops, "k string, value double"), ["k"]).first()
    assert row["n_effective"] == 49 and row["statistic"] == 0 and 1e-11 < row["p_value"] < 5.6e-10  # the report's 2.83e-10 lies between: ties narrow the law


def test_tau_b_with_ties_and_long_lists(spark):
    from rankloom.functions.stats import tau_b, tau_b_of

    rng = np.random.default_rng(3)
    rows = [([], []), ([1.0], [2.0]), ([1.0, 1.0], [1.0, 2.0]), ([1.0, 2.0], [2.0, 1.0]), (None, [1.0]), ([1.0, 2.0], [1.0])]
    for n, k in ((7, 3), (40, 5), (200, 1000)):
        rows.append((rng.integers(0, k, n).astype(float).tolist(), rng.integers(0, k, n).astype(float).tolist()))

    def brute(x, y):
        if x is None or y is None or len(x) != len(y):
            return None
        sign = [(np.sign(a - c), np.sign(b - d)) for i, (a, b) in enumerate(zip(x, y, strict=True)) for c, d in list(zip(x, y, strict=True))[:i]]
        up, nx, ny = sum(a * b for a, b in sign), sum(a != 0 for a, _ in sign), sum(b != 0 for _, b in sign)
        return float(up / np.sqrt(nx * ny)) if nx and ny else 0.0

    got = [r[0] for r in spark.createDataFrame(rows, "x array<double>, y array<double>").select(tau_b("x", "y")).collect()]
    assert got == [None if (w := brute(x, y)) is None else pytest.approx(w) for x, y in rows]
    long_ = np.arange(10_000.0)
    assert tau_b_of(long_, long_[::-1]) == -1.0 and tau_b_of(long_, long_) == 1.0 and abs(tau_b_of(long_, rng.permutation(long_))) < 0.05



def test_verdicts_from_replies(spark):
    whole = {f"{a}{s}": "e" if s else 3 for a in judge.AXES for s in ("", "_evidence")}
    cases = {
        json.dumps(whole): None, "```JSON\n" + json.dumps(whole) + "\n```": None, json.dumps(whole | {"groundedness": True}): "schema", json.dumps(whole | {"groundedness": 3.5}): "schema",
        json.dumps(whole | {"personalization": "3"}): "schema", json.dumps(whole | {"ranking_coherence": 0}): "schema", json.dumps(whole | {"groundedness_evidence": None}): "schema", "[]": "schema", "": "json", "[" * 5000: "json", None: "json",
    }
    df = spark.createDataFrame([(i, c, None) for i, c in enumerate(cases)], "i int, reply string, error string")
    got = {r["i"]: r for r in validation.verdict_records(df, judge.AXES).collect()}
    for i, want in enumerate(cases.values()):
        assert (got[i]["error"] or "").startswith(want or "") and (got[i]["error"] is None) == (want is None)
        assert (got[i]["groundedness"] == 3) == (want is None)


# --- text and parsing -----------------------------------------------------------------


def test_odd_model_answers(spark):
    rows = ["{" * 200_000 + "}" * 200_000, '{"a":' * 200_000 + "1" + "}" * 200_000, '{"a": "\\ud800"}', '{"a": 1e400}', '{"ranking": [2, 1]}', None, "{" * 10]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = {r["i"]: r for r in df.select("i", parsing.parse_object("t").alias("o"), parsing.parse_ranking("t", F.lit(2)).alias("r"), parsing.is_json("t").alias("j"), parsing.pretty_json("t").alias("p")).collect()}
    assert [got[i]["o"] for i in range(7)] == [None, None, None, None, '{"ranking":[2,1]}', None, None]
    assert got[4]["r"] == [2, 1] and all(got[i]["r"] is None for i in range(7) if i != 4)
    assert not got[0]["j"] and got[4]["j"] and got[0]["p"] is None and got[2]["p"] is None
    assert df.select(parsing.parse_ranking("t", F.lit(None).cast("int")).alias("r")).filter("r IS NOT NULL").count() == 0


def test_white_space_is_that_of_python(spark):
    raw = "\x1c a\x1d\x1e\x1fb\x85 c\xa0　 "
    row = spark.createDataFrame([(raw,)], "t string").select(text.snippet(F.col("t")).alias("s"), text.stripped(F.col("t")).alias("u"), validation.blank(F.lit("\x1f ")).alias("b"), text.strip_fence(F.lit("\x1c```JSON\n{}\n``` ")).alias("f")).first()
    assert tuple(row) == (" ".join(raw.split()), raw.strip(), True, "{}")


def test_coercion_leaves_other_text_untouched(spark):
    row = spark.createDataFrame([(["3", "b1", None, "-1", "007"],)], "r array<string>").select(text.coerced(F.col("r")).alias("c"), text.opaque(F.col("r")).alias("o")).first()
    assert [None if c is None else tuple(c) for c in row["c"]] == [(3, None), (None, "b1"), None, (None, "-1"), (7, None)]
    assert row["o"] == ["b1", None, "-1"]


def test_token_estimate(spark):
    got = spark.createDataFrame([("x" * 9,), ("",), (None,)], "t string").select(text.token_estimate(F.col("t"))).collect()
    assert [r[0] for r in got] == [2, 1, 1]


# --- perturbations, merging, bias -----------------------------------------------------


def test_perturbed_cache(spark):
    whole = {"persona": "p", "rationales": [{"candidate_index": i, "reason": f"r{i}"} for i in (2, 1, 3)], "ranking": [3, 1, 2]}
    short = {"persona": "p", "rationales": [{"candidate_index": 1, "reason": "r"}], "ranking": [9]}
    cache = spark.createDataFrame([("a", "x", json.dumps(whole)), ("b", None, json.dumps(short)), ("c", "x", "not JSON"), ("d", "x", "[1]"), ("", "x", json.dumps(whole)), (None, "x", json.dumps(whole)), ("e", "x", None)], "sample_id string, positive_business_id string, output_text string")
    ids = spark.createDataFrame([("a", ["x", "y", "z"])], "sample_id string, ids array<string>")
    got = {k: {r["sample_id"]: r for r in perturb.perturbed_cache(cache, ids, k).collect()} for k in perturb.REGISTRY}
    assert all(set(g) == {"a", "b"} for g in got.values())
    p1, p2, p3 = (json.loads(got[k]["a"]["output_text"]) for k in ("p1", "p2", "p3"))
    assert sorted(p1["ranking"]) == [1, 2, 3] and p1["ranking"] != [3, 1, 2] and p1["rationales"] == whole["rationales"]
    assert [r["candidate_index"] for r in p2["rationales"]] == [1, 2, 3] and all(r["reason"] != f"r{r['candidate_index']}" for r in p2["rationales"]) and p2["ranking"] == [3, 1, 2]
    assert p3 == whole | {"persona": perturb.GENERIC_PERSONA}
    assert got["p3"]["a"]["recovered_business_ids"] == ["z", "x", "y"] and got["p3"]["b"]["recovered_business_ids"] == [None]
    assert got["p2"]["b"]["output_text"] == json.dumps(short) and got["p1"]["a"]["backend"] == "teacher-p1-ranking-shuffled"
    with pytest.raises(ValueError, match="p9"):
        perturb.perturbed_cache(cache, ids, "p9")


def test_perturbed_cache_parses_each_text_once(spark):
    """The parse is neither repeated in filters nor copied to the side of the candidates; several kinds share it."""
    text = F.concat(F.lit('{"persona": "p", "rationales": [], "ranking": [1, 2, '), F.col("id").cast("string"), F.lit("]}"))
    cache = spark.range(3, 40).select(F.col("id").alias("sample_id"), F.lit("x").alias("positive_business_id"), text.alias("output_text"))
    ids = spark.range(40).select(F.col("id").alias("sample_id"), F.array(F.lit("x"), F.lit("y"), F.lit("z")).alias("ids"))
    single = {k: perturb.perturbed_cache(cache, ids, k) for k in ("p1", "p2", "p3")}
    several = perturb.perturbed_cache(cache, ids, list(single))
    for df in [*single.values(), several]:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython [bare_objects(") == 1
        assert plan.count("from_json") == 1
        assert plan.count("is_json") == 0
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert rows(several) == sorted(x for df in single.values() for x in rows(df))


@pytest.mark.parametrize("text", ["", " {} ", '```json\n{"k": 1}\n```', '```JSON{"k": 2}```', "`{}`", '```\u2003json \x1c{"k": 3}\x85```', "```jſon{}```", '{"k": 1} tail', "[1]", '{"k": NaN}', "\u3000{}\xa0", "```", '``````{"k": 4}\n`', "{", None])
def test_bare_object_is_the_text_without_its_fence(spark, text):
    from rankloom.functions.text import strip_fence

    df = spark.createDataFrame([(text,)], "t string")
    bare = strip_fence(F.coalesce("t", F.lit("")))
    want = df.select(F.when(bare.startswith("{") & parsing.is_json(bare), bare).alias("o")).first()["o"]
    assert df.select(parsing.bare_object("t").alias("o")).first()["o"] == want


def test_own_perturbations_join_the_registry(spark):
    @perturb.register("p0", "own")
    def emptied(out, seed):
        return perturb.output(F.lit(""), out["rationales"], out["ranking"])

    try:
        cache = spark.createDataFrame([("a", "x", '{"persona": "p"}')], "sample_id string, positive_business_id string, output_text string")
        ids = spark.createDataFrame([], "sample_id string, ids array<string>")
        assert perturb.perturbed_cache(cache, ids, "p0").first()["output_text"] == '{"persona": "", "rationales": [], "ranking": []}'
    finally:
        del perturb.REGISTRY["p0"]


def test_position_bias_of_odd_rankings(spark):
    rows = [([1, 2], 1), ([2, 1], 1), ([2, 1], None), ([1, 1], 1), (None, 1), ([1], 2)]
    df = spark.createDataFrame(rows, "r array<int>, gt int")
    got = bias.position_bias(df, "r", "gt", k=2).first()
    assert (got["n_valid"], got["top1_slot_counts"], got["slot1_top1_rate"], got["recall_by_gt_position"], got["recall_support"]) == (3, [1, 2], 0.3333, [0.5, None], [2, 0])
    assert got["chi2_uniform"] == 0.333 and got["chi2_pvalue"] == pytest.approx(0.563703, abs=1e-6)
    assert bias.position_bias(df.limit(0), "r", "gt").count() == 0


def test_backfill_leaves_what_is_there(spark):
    summaries = spark.createDataFrame([("has", {"ndcg@5": 0.5, "ndcg@10": 0.5}), ("half", {"ndcg@5": 0.9, "old": 1.0}), ("none", None), ("no raw", {"old": 1.0})], "tag string, student map<string,double>")
    raw = spark.createDataFrame([(t, s, [2, 1], p) for t in ("has", "half", "none") for s, p in (("a", "b"), ("gone", "b"))], "tag string, sample_id string, ranking array<int>, positive string")
    known = spark.createDataFrame([("a", ["x", "b"], None)], "sample_id string, ids array<string>, positive string")
    got = {r["tag"]: r for r in merging.backfill(summaries, raw, known).collect()}
    assert {t: r["status"] for t, r in got.items()} == {"has": "already_has_ndcg", "half": "updated", "none": "updated", "no raw": "skipped_no_raw"}
    assert got["half"]["student"]["ndcg@5"] == 0.5 and got["half"]["student"]["old"] == 1.0 and got["none"]["student"]["n_evaluated"] == 2.0
    assert got["has"]["student"] == {"ndcg@5": 0.5, "ndcg@10": 0.5} and got["no raw"]["student"] == {"old": 1.0}


def test_merged_record(spark):
    up, down = list(range(1, 11)), list(range(10, 0, -1))
    first = spark.createDataFrame([("a", "u", up), ("b", "u", [1])], "sample_id string, user_id string, ranking array<int>")
    second = spark.createDataFrame([("a", up, down), ("b", up, down)], "sample_id string, ranking array<int>, permutation array<int>")
    rows = merging.merge_records(first, second).collect()
    assert len(rows) == 1 and rows[0]["ranking"] == up and rows[0]["user_id"] == "u"
    m = rows[0]["merge"]
    assert m["pass2_ranking_original_space"] == down and m["kendall_tau"] == -1.0 and not m["top1_agreement"] and m["borda_scores"] == [9] * 10
    assert "permutation" not in rows[0].__fields__ and ranks.SLOTS == 10


# --- work lists -------------------------------------------------------------------


def test_coverage_names_what_is_missing(spark):
    wanted, have = spark.createDataFrame([(x,) for x in "abcdefg"], "id string"), spark.createDataFrame([("c",)], "id string")
    with pytest.raises(ValueError, match="6 samples are missing, the first: .'a', 'b', 'd', 'e', 'f'."):
        resume.require(wanted, have, ["id"], "samples")
    resume.require(have, wanted, ["id"], "samples")


def test_counters_without_a_pass_of_their_own(spark):
    df, seen = resume.observed(spark.createDataFrame([(1, None), (2, "x"), (3, None)], "i int, error string"), "progress")
    assert df.count() == 3 and seen.get == {"ok": 2, "failed": 1, "rate": pytest.approx(2 / 3)}


# --- files and reports ----------------------------------------------------------------


def test_caches_of_one_name_keep_their_order(spark, tmp_path):
    for d, said in (("b", "first"), ("a", "second")):
        (tmp_path / d).mkdir()
        (tmp_path / d / "cache.json").write_text(json.dumps({"backend": "m", "samples": [{"sample_id": "s", "output_text": said}]}))
    got = results.read_cache(spark, [str(tmp_path / "b/cache.json"), str(tmp_path / "a/cache.json")]).collect()
    assert [r["output_text"] for r in got] == ["second"]
    (tmp_path / "none.json").write_text('{"backend": "m"}')
    with pytest.raises(Exception, match="a cache without samples"):
        results.read_cache(spark, [str(tmp_path / "none.json")]).collect()


def test_replaced_table_leaves_a_backup(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    backup = results.replace(spark.read.parquet(path).filter("id > 0"), path, "v1")
    assert spark.read.parquet(path).count() == 2 and spark.read.parquet(backup).count() == 3
    with pytest.raises(ValueError):
        results.replace(spark.range(1), path, "v1")


def test_summary_sink_and_slot1(spark, tmp_path):
    path = str(tmp_path / "eval_x.json")
    results.write_summary({"tag": "x", "position_bias": {"slot1_top1_rate": 0.25, "chi2_uniform": math.nan}}, path, spark)
    assert json.loads((tmp_path / "eval_x.json").read_text()) == {"tag": "x", "position_bias": {"slot1_top1_rate": 0.25, "chi2_uniform": None}}
    assert results.slot1_rate(spark, path) == 0.25 and results.slot1_rate(spark, str(tmp_path / "gone.json")) is None
    with pytest.raises(ValueError):
        results.markdown(spark.range(5), limit=4)


def test_cells():
    assert [reports.cell(x) for x in (None, 0.12345, 1234.56, 7, "t")] == ["—", "0.123", "1234.6", "7", "t"] and reports.cell(None, csv_form=True) == ""
    assert reports.interval(1.0, 0.5, 1.5) == "1.00 [0.50, 1.50]" and reports.interval(-1.0, -1.5, 0.5, sign=True) == "-1.00 [-1.50, +0.50]" and reports.interval(math.nan, 0, 0) == "--"
    assert reports.correlation(0.123, 0.04, 50) == "+0.12 (p=0.04, n=50)" and reports.correlation(None, None, 0) == "--"
    assert reports.signed_rank(2.83e-10, 49) == "p=2.83e-10 (n_eff=49)" and reports.signed_rank(None, 0, "why") == "(n_eff=0; why)" and reports.signed_rank(None, 1) == "(n_eff=1; no p)"


def test_reports(spark, sf_dir):
    from rankloom.plans import measures, ranking
    from rankloom.plans.base import Tables

    t = Tables(spark, sf_dir)
    runs = spark.createDataFrame([("v2-sft", "v2-sft", "fp16", 0.5), ("zz", "zz", "fp16", None), ("base-x", "base", "fp16", 0.25)], "tag string, recipe string, quant string, `recall@1` double")
    steps = spark.createDataFrame([("gain", "base-x", "v2-sft", 0.25), ("gap", "gone", "v2-sft", None)], "label string, a string, b string, delta double")
    text_ = reports.comparison(runs, steps)
    assert [x.split(" | ")[0] for x in text_.splitlines()[2:5]] == ["| base-x", "| v2-sft", "| zz"] and "+0.250" in text_ and "| gone | v2-sft | — |" in text_
    assert reports.comparison_csv(runs).splitlines()[1].startswith("base-x,base,fp16,0.250,,")
    one = spark.createDataFrame([("teacher", 0.1, 0.9)], "name string, `recall@1` double, parse_rate double")
    assert "| teacher | 0.100 | -- |" in reports.summary(one)
    shown = reports.validation(measures.validated(t), measures.baseline(t))
    assert len(shown.splitlines()) == 17 and "| p1 | groundedness |" in shown
    none = measures.validated(t).withColumn("n", F.when(F.col("probe") == "p2", 0).otherwise(F.col("n")))
    assert len(reports.validation(none).splitlines()) == 9 and "| p2 | all | 0 | -- | -- | -- | -- | missing |" in reports.validation(none)
    whole = reports.judge(judge.per_model(measures.tagged_verdicts(t)), measures.agreement(t))
    assert len(whole.splitlines()) == 30 and "groundedness and MRR" in whole and "chars max" in whole
    assert len(reports.slots(bias.described(ranking.tops(t), ["model"]), "model").splitlines()) == 20
    assert len(reports.recall_by_slot(bias.recall_by_slot(t.rankings(), F.col("gt"), F.get("teacher", F.lit(0)))).splitlines()) == 12
    rates = spark.createDataFrame([("b", 1.0, 2.0, 0.5, 0.75, 10.0, 1.0, 0.1)], "backend string, latency_p50 double, latency_p95 double, per_tok_p50 double, per_tok_p95 double, tokens_mean double, tokens_std double, failure_rate double")
    assert "| b | 1.0 / 2.0 | 0.50 / 0.75 | 10 (1) | 10.0% |" in reports.latency(rates)
