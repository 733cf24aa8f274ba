"""Rank algebra as column expressions over arrays; slots and ranks count from 1.

Everything here stays inside the JVM: higher-order functions over arrays of a
bounded length, never one row per pair.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS = 10


def int_(n: int) -> Column:
    return F.lit(n).cast("int")


def slots(k: int = SLOTS) -> Column:
    return F.sequence(int_(1), int_(k))


def is_permutation(ranking: Column, k: Column | int = SLOTS) -> Column:
    """The array holds each of 1..k once; false for NULL."""
    k = F.lit(k) if isinstance(k, int) else k
    whole = (k > 0) & (F.array_sort(ranking) == F.sequence(int_(1), F.greatest(k, F.lit(1)).cast("int")))
    return F.coalesce(whole, F.lit(False))


def rank_of(ids: Column, wanted: Column) -> Column:
    """1-based rank of an id in a list; NULL if it isn't there or either is NULL."""
    return F.nullif(F.array_position(ids, wanted), F.lit(0).cast("long"))


def hit_at(rank: Column, k: int) -> Column:
    """1.0 if the rank exists and is at most k, else 0.0."""
    return F.when(rank <= k, 1.0).otherwise(0.0)


def reciprocal(rank: Column) -> Column:
    """1 / rank without a cutoff; 0.0 where there is no rank."""
    return F.coalesce(F.lit(1.0) / rank, F.lit(0.0))


def gain_at(rank: Column, k: int) -> Column:
    """NDCG of a single relevant item: 1 / log2(rank + 1) within the first k."""
    return F.when(rank <= k, F.lit(1.0) / F.log2(rank + 1)).otherwise(0.0)


def kendall_tau(a: Column, b: Column, k: int = SLOTS) -> Column:
    """(concordant - discordant) / pairs of two orders of one set; NULL if sets or lengths differ or there are fewer than two.

    Orders of k items have their k (k - 1) / 2 comparisons written out; other
    lengths go through a loop of the same comparisons.
    """
    n = F.size(a)
    place = F.transform(a, lambda x: F.array_position(b, x).cast("int"))

    def written_out(v: Column) -> Column:
        at = [F.get(v, int_(i)) for i in range(k)]
        signs = [F.signum((at[j] - at[i]).cast("double")) for j in range(k) for i in range(j)]
        while len(signs) > 1:  # a balanced sum keeps the expression shallow
            signs = [x + y for x, y in zip(signs[::2], signs[1::2], strict=False)] + signs[len(signs) // 2 * 2 :]
        return signs[0]

    def with_later(v: Column):
        def add(total: Column, j: Column) -> Column:
            at = F.element_at(v, j)
            return total + F.aggregate(F.slice(v, F.lit(1), j - 1), F.lit(0.0), lambda s, x: s + F.signum((at - x).cast("double")))

        return F.aggregate(F.sequence(F.lit(2), F.greatest(F.size(v), F.lit(2))), F.lit(0.0), add)

    balance = F.get(F.transform(F.array(place), lambda v: F.when(F.size(v) == k, written_out(v)).otherwise(with_later(v))), int_(0))
    same = (n >= 2) & (n == F.size(b)) & (F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b)))
    return F.when(same, balance / (n * (n - 1) / F.lit(2.0)))


def rank_vector(ranking: Column, k: int = SLOTS) -> Column:
    """Inverse permutation, from 0: place of slot s at index s."""
    return F.transform(slots(k), lambda s: (F.array_position(ranking, s) - 1).cast("int"))


def compose(ranking: Column, permutation: Column) -> Column:
    """A ranking of shown slots in terms of the original ones."""
    return F.transform(ranking, lambda x: F.element_at(permutation, x))


def pick(items: Column, ranking: Column) -> Column:
    """Items in the order of the ranking; a slot out of range gives NULL in its place."""
    return F.transform(ranking, lambda i: F.when((i >= 1) & (i <= F.size(items)), F.get(items, i - 1)))


def pick_strict(items: Column, ranking: Column) -> Column:
    """Items in the order of the ranking if that is a permutation of their slots, else NULL."""
    return F.when(is_permutation(ranking, F.size(items)), pick(items, ranking))


def permuted(items: Column, permutation: Column) -> Column:
    """Items dealt by a permutation; an error if it isn't one of their slots."""
    return F.when(is_permutation(permutation, F.size(items)), pick(items, permutation)).otherwise(F.raise_error(F.lit("the permutation doesn't fit the candidates")).cast("array<int>"))


def make_permutation(kind: str, k: int = SLOTS) -> Column:
    if kind == "identity":
        return slots(k)
    if kind == "reverse":
        return F.sequence(int_(k), int_(1), int_(-1))
    raise ValueError(f"no permutation is called {kind!r}")


def borda_scores(first: Column, second: Column, k: int = SLOTS) -> Column:
    """Points of each slot, by slot: k - 1 less its place, over both rankings."""
    return F.transform(slots(k), lambda s: (F.lit(2 * k) - F.array_position(first, s) - F.array_position(second, s)).cast("int"))


def borda_merge(first: Column, second: Column, k: int = SLOTS) -> Column:
    """Slots by points, most first; ties keep the order of the first ranking."""
    keyed = F.transform(slots(k), lambda s: F.struct((F.array_position(first, s) + F.array_position(second, s)).alias("loss"), F.array_position(first, s).alias("place"), s.alias("slot")))
    return F.transform(F.array_sort(keyed), lambda x: x["slot"])


def random_mrr(k: int = SLOTS) -> Column:
    """Expected reciprocal rank of a random order."""
    return F.aggregate(slots(k), F.lit(0.0), lambda s, r: s + F.lit(1.0) / r) / F.lit(float(k))
