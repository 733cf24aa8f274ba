"""Rank algebra on small inputs."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.functions import ranks


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)))
    return df.select(column.alias("x")).first()["x"]


def test_reciprocal_of_second(spark):
    r = ranks.rank_of(F.col("ids"), F.col("p"))
    got = lambda c: one(spark, c, ids=["b", "a", "c"], p="a")
    assert (got(ranks.hit_at(r, 1)), got(ranks.hit_at(r, 5)), got(ranks.reciprocal(r))) == (0.0, 1.0, 0.5)
    assert got(ranks.gain_at(r, 5)) == pytest.approx(0.6309297535714575)


def test_absent_positive_counts_as_zero(spark):
    r = ranks.rank_of(F.col("ids"), F.col("p"))
    for c in (ranks.hit_at(r, 1), ranks.reciprocal(r), ranks.gain_at(r, 5)):
        assert one(spark, c, ids=["b", "c"], p="a") == 0.0


def test_tau_of_one_swap(spark):
    tau = ranks.kendall_tau(F.col("a"), F.col("b"))
    assert one(spark, tau, a=list("abcd"), b=list("bacd")) == pytest.approx(4 / 6)
    assert one(spark, tau, a=list("abcd"), b=list("dcba")) == -1.0


@pytest.mark.parametrize(("a", "b"), [(["a"], ["a"]), (["a", "b"], ["a", "c"]), (["a", "b"], ["a", "b", "b"])])
def test_tau_is_null_without_a_common_set(spark, a, b):
    assert one(spark, ranks.kendall_tau(F.col("a"), F.col("b")), a=a, b=b) is None


def test_borda_tie_goes_to_the_first_pass(spark):
    up, down = list(range(1, 11)), list(range(10, 0, -1))
    assert one(spark, ranks.borda_merge(F.col("a"), F.col("b")), a=up, b=down) == up
    assert one(spark, ranks.borda_merge(F.col("a"), F.col("b")), a=down, b=down) == down


def test_out_of_range_slot_is_null(spark):
    assert one(spark, ranks.pick(F.col("c"), F.col("r")), c=["a", "b"], r=[1, 5, 2]) == ["a", None, "b"]
    assert one(spark, ranks.pick_strict(F.col("c"), F.col("r")), c=["a", "b"], r=[1, 5]) is None


def test_misfit_permutation_is_an_error(spark):
    with pytest.raises(Exception, match="doesn't fit"):
        one(spark, ranks.permuted(F.col("c"), F.col("r")), c=[7, 8, 9], r=[1, 2])
    with pytest.raises(ValueError, match="spiral"):
        ranks.make_permutation("spiral")


@pytest.mark.parametrize("r", [[1, 2, 3, 3], [1, 2, 3], [1, 2, 3, 99], [], [1, 2, 3, 4, 5]])
def test_bad_rankings(spark, r):
    column = F.array(*map(F.lit, r)).cast("array<int>") if r else F.array().cast("array<int>")
    assert spark.range(1).select(ranks.is_permutation(column, 4)).first()[0] is False


@settings(max_examples=15, deadline=None)
@given(st.permutations(range(1, 11)), st.permutations(range(1, 11)))
def test_properties_of_permutations(spark, a, b):
    df = spark.createDataFrame([(list(a), list(b))], "a array<int>, b array<int>")
    row = df.select(
        ranks.kendall_tau(F.col("a"), F.col("b")).alias("ab"), ranks.kendall_tau(F.col("b"), F.col("a")).alias("ba"), ranks.borda_merge(F.col("a"), F.col("b")).alias("m"),
        ranks.compose(F.col("a"), F.col("b")).alias("c"), ranks.rank_vector(F.col("a")).alias("v")).first()
    assert row["ab"] == pytest.approx(row["ba"])
    assert sorted(row["m"]) == sorted(row["c"]) == list(range(1, 11))
    assert [row["v"][s - 1] for s in a] == list(range(10))
    points = {s: a.index(s) + b.index(s) for s in a}
    assert row["m"] == sorted(a, key=lambda s: (points[s], a.index(s)))
