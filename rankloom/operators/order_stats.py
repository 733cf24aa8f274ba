"""Percentiles and ranks: four definitions, exact and distributed.

A percentile needs no sort of its group.  One pass sketches each group's
distribution; the sketch's known error gives every wanted rank a bracket of
values that holds it, a few ten-thousandths of the rows.  A second pass counts
what lies below the brackets and keeps only what lies inside, and the value at
the rank follows exactly.  Ranks of all rows come from range partitions and
their prefix sums, so that no group, however large, is one task.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.sources.staged import Staged

#: 1 / ACCURACY is the sketch's largest error of a rank, as a share of the group.
ACCURACY = 10_000
#: Half width of a bracket, as a share of the group; several times the error.
HALF = 5e-4
#: Smaller groups are their own bracket.
WHOLE = 10_000


class Place(NamedTuple):
    """A rank (from 1) as a function of the group's size, and the share of the group near which it lies."""

    share: float
    rank: Callable[[Column], Column]


def nearest_rank(p: float) -> Place:
    """P1: rank ceil(p / 100 * n), at least 1 and at most n; p in percent."""
    return Place(p / 100.0, lambda n: F.least(n, F.greatest(F.lit(1), F.floor(F.lit(p / 100.0) * n + 0.999999))))


def half_even(p: float) -> Place:
    """P2: index round(p * (n - 1)) from 0, ties to even."""
    return Place(p, lambda n: F.bround(F.lit(float(p)) * (n - 1)).cast("long") + 1)


def floored(p: float) -> Place:
    """P4: index int(p * n) from 0, at most the last; the middle is n // 2."""
    return Place(p, lambda n: F.least(n, F.floor(F.lit(float(p)) * n).cast("long") + 1))


def pick(df: DataFrame, keys: list[str], value: str, places: dict[str, Place]) -> DataFrame:
    """keys, n and a column for each place: the value at that rank among the group's values, NULLs left out; groups of NULL keys count as any other.

    Groups without a value have no row (without keys: one row of NULLs, n 0).
    """
    some = df.select(*keys, F.col(value).alias("__v")).filter("__v IS NOT NULL")
    ends = [max(0.0, min(1.0, place.share + side)) for place in places.values() for side in (-HALF, HALF)]
    sketch = some.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"), F.percentile_approx("__v", ends, ACCURACY).alias("__at"))
    small = F.col("__n") <= WHOLE
    bracket = [F.struct(F.lit(i).alias("j"), F.when(small, F.col("__min")).otherwise(F.get("__at", F.lit(2 * i))).alias("lo"), F.when(small, F.col("__max")).otherwise(F.get("__at", F.lit(2 * i + 1))).alias("hi"), place.rank(F.col("__n")).cast("long").alias("rank")) for i, place in enumerate(places.values())]
    named = {k: f"__k{i}" for i, k in enumerate(keys)}
    sketch = sketch.select(*[F.col(k).alias(v) for k, v in named.items()], "__n", F.array(*bracket).alias("__b"))
    same = F.lit(True)
    for k, v in named.items():
        same = same & F.col(k).eqNullSafe(F.col(v))
    met = some.join(sketch, same) if keys else some.crossJoin(F.broadcast(sketch))  # without keys the sketch is one row
    # of each row and place: the value inside the bracket, NULL below it, nothing above it
    cells = met.select(*named.values(), "__n", "__v", F.explode("__b").alias("b")).filter("__v <= b.hi").select(*named.values(), "__n", "b.j", "b.rank", F.when(F.col("__v") >= F.col("b.lo"), F.col("__v")).alias("__v"))
    counted = cells.groupBy(*named.values(), "__n", "j", "rank", "__v").agg(F.count("*").alias("__m"))
    upto = Window.partitionBy(*named.values(), "j").orderBy(F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("__upto", F.sum("__m").over(upto)).filter("__v IS NOT NULL AND __upto >= rank")
    at = [F.min(F.when(F.col("j") == i, F.col("__v"))).alias(name) for i, name in enumerate(places)]
    out = ranked.groupBy(*named.values()).agg(F.coalesce(F.max("__n"), F.lit(0)).alias("n"), *at)
    return out.withColumnsRenamed({v: k for k, v in named.items()})


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """P3: keys, n and a double for each share, interpolated linearly between the two values about (n - 1) * share."""
    step = lambda p: (lambda n: (n - 1) * F.lit(float(p)))
    places = {}
    for name, p in shares.items():
        at = step(p)
        places[f"__lo_{name}"] = Place(p, lambda n, at=at: F.floor(at(n)) + 1)
        places[f"__hi_{name}"] = Place(p, lambda n, at=at: F.ceil(at(n)) + 1)
    found = pick(df, keys, value, places)

    def between(name: str, p: float) -> Column:
        low, high, at = F.col(f"__lo_{name}").cast("double"), F.col(f"__hi_{name}").cast("double"), step(p)(F.col("n"))
        return (low + (high - low) * (at - F.floor(at))).alias(name)

    return found.select(*keys, "n", *[between(name, p) for name, p in shares.items()])


def running(df: DataFrame, keys: list[str], order: list[str], weight: Column, name: str) -> DataFrame:
    """Add the sum of weights of a group's rows up to each row, in the order, which must be total.

    Rows are dealt to ranges of (keys, order) and staged, so that every step
    sees the same ranges; the ranges' sums are one row a group and range, and
    only they are added up in one place.
    """
    part, before, mass = "__part", "__before", "__mass"
    ranged = df.withColumn(mass, weight).repartitionByRange(*[F.col(c) for c in [*keys, *order]]).withColumn(part, F.spark_partition_id())
    ranged = Staged(ranged, "ranges").df
    sums = ranged.groupBy(*keys, part).agg(F.sum(mass).alias(before))
    ahead = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    named = {c: f"__r{i}" for i, c in enumerate([*keys, part])}
    sums = sums.withColumn(before, F.coalesce(F.sum(before).over(ahead), F.lit(0))).withColumnsRenamed(named)
    same = F.lit(True)
    for c, v in named.items():
        same = same & F.col(c).eqNullSafe(F.col(v))
    inside = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = ranged.join(sums, same).withColumn(name, F.col(before) + F.sum(mass).over(inside))
    return met.drop(part, before, mass, *named.values())
