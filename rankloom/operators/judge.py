"""Judge verdicts: pairs of arms, signed ranks, correlations, labels and intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.stats import correlation_p, normal_p, signed_rank_p
from rankloom.sources.staged import Staged

from .order_stats import quantiles, running

AXES = ["groundedness", "personalization", "ranking_coherence"]

#: Distinct values of a group that one task resamples, on average, and children of a node above them.
CELL, FANOUT = 4096, 256
#: Differences up to which the law of signed ranks is counted out.
EXACT = 50

# Drop that each perturbation should cause on each axis.
EXPECTED_DROP = [
    ("p1", "groundedness", 0.0), ("p1", "personalization", 0.0), ("p1", "ranking_coherence", -1.5),
    ("p2", "groundedness", -2.0), ("p2", "personalization", -2.0), ("p2", "ranking_coherence", -1.0),
    ("p3", "groundedness", 0.0), ("p3", "personalization", -1.0), ("p3", "ranking_coherence", 0.0),
]


def pairs(verdicts: DataFrame, key: str, arm: str, base: str, probes: list[str], order: list[str] | None = None) -> DataFrame:
    """Clean verdicts of a base arm and of each probe arm side by side: key, probe and, for each axis, base_, probe_ and delta_.

    One pass: verdicts meet once, by key, however many probes there are.  Of
    several clean verdicts of one key and arm the last by ``order`` (the log's
    order) counts; rows with a NULL or empty key or arm have no pair.  A score
    that isn't there, or isn't a whole number, leaves its delta NULL.
    """
    whole = lambda a: F.when(F.col(a) == F.floor(a), F.col(a).cast("long")).alias(a)
    clean = verdicts.filter(F.col("error").isNull() & F.col(arm).isin(base, *probes) & F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    scores = F.struct(*map(whole, AXES))
    place = F.struct(*(order or []), scores)  # a total order: equal places hold equal scores
    last = clean.groupBy(key).agg(*[F.max_by(scores, F.when(F.col(arm) == a, place)).alias(f"__{i}") for i, a in enumerate([base, *probes])])
    arms = F.array(*[F.struct(F.lit(p).alias("probe"), F.col(f"__{i + 1}").alias("p")) for i, p in enumerate(probes)])
    both = last.filter("__0 IS NOT NULL").select(key, F.col("__0").alias("b"), F.inline(arms).alias("probe", "p")).filter("p IS NOT NULL")
    return both.select(key, "probe", *[F.col(f"b.{a}").alias(f"base_{a}") for a in AXES], *[F.col(f"p.{a}").alias(f"probe_{a}") for a in AXES], *[(F.col(f"p.{a}") - F.col(f"b.{a}")).cast("double").alias(f"delta_{a}") for a in AXES])


def deltas(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, probe, axis, value: the differences of pairs, only where both sides have a score."""
    return long_axes(pairs, [*keys, "probe"], "delta_").filter("value IS NOT NULL")


def long_axes(df: DataFrame, keys: list[str], prefix: str = "") -> DataFrame:
    """keys, axis, value."""
    entries = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"{prefix}{a}").cast("double").alias("value")) for a in AXES])
    return df.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.axis", "e.value")


def same_group(keys: list[str], prefix: str) -> tuple[dict[str, str], Column]:
    """Other names for the keys of one side of a join, and the condition that both are equal, NULL with NULL."""
    named = {k: f"{prefix}{i}" for i, k in enumerate(keys)}
    same = F.lit(True)
    for k, c in named.items():
        same = same & F.col(k).eqNullSafe(F.col(c))
    return named, same


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Average rank of each value in its group; a group of NULL keys is one as any other, rows without a value have no rank.  Distinct values are counted and ranked in ranges; their ranks then join the rows."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__m"))
    upto = running(counts, keys, [value], F.col("__m"), "__upto")
    named, same = same_group([*keys, value], "__a")
    ranked = upto.withColumn(name, F.col("__upto") - (F.col("__m") - 1) / F.lit(2.0)).drop("__m", "__upto").withColumnsRenamed(named)
    return df.join(ranked, same, "left").drop(*named.values())


def rank_correlation(df: DataFrame, keys: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """keys, and for each name in ``pairs`` Spearman's rho of two columns over a group's rows that have both, and name_n, how many these are.

    No row is ranked: a pair's joint counts of distinct values are gathered
    first, the ranks of either side follow from running counts of its distinct
    values, and rho from sums over the joint counts.  So a group of few distinct
    values, however many rows it has, is a few rows after the first aggregation.
    """
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("pair"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")) for n, (a, b) in pairs.items()]))
    each = df.select(*keys, long.alias("p")).select(*keys, "p.pair", "p.a", "p.b").filter("a IS NOT NULL AND b IS NOT NULL")
    joint = Staged(each.groupBy(*keys, "pair", "a", "b").agg(F.count("*").alias("m")), "joint").df
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("v")) for s in ("a", "b")]))
    counts = joint.select(*keys, "pair", "m", sides.alias("s")).select(*keys, "pair", "s.side", "s.v", "m").groupBy(*keys, "pair", "side", "v").agg(F.sum("m").alias("m"))
    upto = running(counts, [*keys, "pair", "side"], ["v"], F.col("m"), "upto")
    ranks = Staged(upto.select(*keys, "pair", "side", "v", (F.col("upto") - (F.col("m") - 1) / F.lit(2.0)).alias("rank")), "ranks").df
    for side in ("a", "b"):
        named, same = same_group([*keys, "pair"], f"__{side}")
        own = ranks.filter(F.col("side") == side).select(*[F.col(k).alias(c) for k, c in named.items()], F.col("v").alias(f"__v{side}"), F.col("rank").alias(f"r{side}"))
        joint = joint.join(own, same & (F.col(side) == F.col(f"__v{side}")))
    m, x, y, n = F.col("m"), F.col("ra"), F.col("rb"), F.sum("m")
    xy, xx, yy = (F.sum(m * u * v) - F.sum(m * u) * F.sum(m * v) / n for u, v in ((x, y), (x, x), (y, y)))
    rho = F.when((n >= 3) & (xx > 0) & (yy > 0), F.try_divide(xy, F.sqrt(F.greatest(xx, F.lit(0.0)) * F.greatest(yy, F.lit(0.0))))).otherwise(F.lit(float("nan")))
    found = joint.groupBy(*keys, "pair").agg(n.alias("n"), rho.alias("rho"))
    columns = [c for name in pairs for c in (F.max(F.when(F.col("pair") == name, F.col("rho"))).alias(name), F.coalesce(F.max(F.when(F.col("pair") == name, F.col("n"))), F.lit(0)).alias(f"{name}_n"))]
    return found.groupBy(*keys).agg(*columns)


def wilcoxon(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """n_total, n_effective, statistic (sum of the positive differences' ranks), z, p_value, error text of the one-sided test "less".

    Zeros are dropped.  p_value is exact for up to EXACT differences without
    ties or zeros, else by z, the normal approximation with ties corrected; as
    is a group of one difference, p_value NULL.  Sizes are ranked by running
    counts over ranges, so no group's sizes meet in one task; groups of NULL
    keys count.
    """
    sized = deltas.filter("value IS NOT NULL").withColumn("size", F.abs("value"))
    counts = Staged(sized.groupBy(*keys, "size").agg(F.count("*").alias("m"), F.count(F.when(F.col("value") > 0, 1)).alias("up")), "sizes").df
    ranked = running(counts.filter("size > 0"), keys, ["size"], F.col("m"), "upto").withColumn("rank", F.col("upto") - (F.col("m") - 1) / F.lit(2.0))
    zeros = counts.filter("size = 0").select(*keys, F.lit(0.0).alias("rank"), F.lit(0).cast("long").alias("m0"), F.col("m").alias("zeros"), F.lit(0).cast("long").alias("up"))
    every = ranked.select(*keys, "rank", F.col("m").alias("m0"), F.lit(0).cast("long").alias("zeros"), "up").unionByName(zeros)
    m, n = F.col("m0").cast("double"), F.sum("m0").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24.0 - F.sum(m * m * m - m) / 48.0
    w = F.sum(F.col("rank") * F.col("up"))
    s = every.groupBy(*keys).agg((F.sum("m0") + F.sum("zeros")).alias("n_total"), F.sum("m0").alias("n_effective"), F.coalesce(w, F.lit(0.0)).alias("statistic"), F.try_divide(w - n * (n + 1) / 4.0, F.sqrt(variance)).alias("z"), (F.max("m0") > 1).alias("tied"), F.sum("zeros").alias("zeros"))
    exact = ~F.col("tied") & (F.col("zeros") == 0) & (F.col("n_effective") <= EXACT)
    p = F.when(F.col("n_effective") > 1, F.when(exact, signed_rank_p("statistic", "n_effective")).otherwise(F.lit(1.0) - normal_p("z")))
    few = F.when(F.col("n_effective") == 0, "all deltas are zero (no signed ranks)").when(F.col("n_effective") == 1, "fewer than 2 non-zero deltas")
    return s.select(*keys, "n_total", "n_effective", "statistic", F.when(F.col("n_effective") > 1, F.col("z")).alias("z"), p.alias("p_value"), few.alias("error"))


def discrimination(delta: Column) -> Column:
    """Share of negative differences; NaN for none."""
    return F.when(F.count(delta) > 0, F.count(F.when(delta < 0, 1)) / F.when(F.count(delta) > 0, F.count(delta))).otherwise(F.lit(float("nan")))


def probe_label(mean: Column, low: Column, high: Column, expected: Column) -> Column:
    """Seven labels from the mean difference, its interval and the drop expected."""
    unknown = mean.isNull() | F.isnan(mean) | low.isNull() | F.isnan(low) | high.isNull() | F.isnan(high)
    drops = F.when(low > 0, "inverted").when(high >= 0, "null").when(mean <= expected, "pass").otherwise("weak")
    return F.when(unknown, "insufficient").when(expected < 0, drops).when(high < 0, "unexpected-drop").otherwise("consistent")


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r as an aggregate; NaN for fewer than three pairs or no variance on a side."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)  # corr() itself divides by zero where a side doesn't vary
    return F.when((F.count(x) >= 3) & (spread > 0), F.try_divide(F.covar_pop(x, y), spread)).otherwise(F.lit(float("nan")))


def with_correlation_p(df: DataFrame, r: str = "r", n: str = "n") -> DataFrame:
    return df.withColumn("p", correlation_p(F.col(r), F.col(n)))


def bootstrap(values: DataFrame, keys: list[str], value: str = "value", resamples: int = 10_000, cell: int = CELL, fanout: int = FANOUT) -> DataFrame:
    """keys, n, mean, low, high: percentile bootstrap of each group's mean (95 %), NULLs left out, groups of NULL keys as any other.

    One law at every size: a resample draws n of the group's n values with
    replacement.  So its counts of the distinct values are multinomial.
    Distinct values are dealt to cells of about ``cell``; cells are the leaves
    of a tree.  A resample's draws split at each node among its children, again
    by a multinomial, and so down to the values of a cell.  A node's draws follow from
    its place in the tree alone, so every cell finds its own share of them,
    and no task holds more than a cell and the nodes above it; the cells' sums
    add up to those of the resamples.
    """
    some = values.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    counts = Staged(some.groupBy(*keys, "v").agg(F.count("*").alias("m")), "values").df
    sizes = Staged(counts.groupBy(*keys).agg(F.sum("m").alias("n"), F.count("*").alias("d"), (F.sum(F.col("v") * F.col("m")) / F.sum("m")).alias("mean")), "groups").df
    most = sizes.agg(F.max("d")).first()[0] or 0
    depth = 0
    while cell * fanout**depth < most:
        depth += 1
    named, same = same_group(keys, "__k")
    # a group of d values has as many cells as it needs, dealt by a hash of the value
    own = sizes.select(*[F.col(k).alias(c) for k, c in named.items()], F.ceil(F.col("d") / cell).alias("cells"), "n")
    placed = counts.join(own, same) if keys else counts.crossJoin(F.broadcast(own))
    placed = placed.drop(*named.values()).withColumn("cell", F.pmod(F.xxhash64("v"), F.col("cells")))
    paths = placed.select(*keys, "n", "cell").distinct().withColumn("path", F.array().cast("array<array<long>>"))
    for level in range(depth):  # the sizes of a node's children, from the root down
        width = fanout ** (depth - 1 - level)
        node = [*keys, "__node"]
        children = placed.groupBy(*keys, F.floor(F.col("cell") / (width * fanout)).alias("__node"), F.floor(F.col("cell") / width).alias("child")).agg(F.sum("m").alias("m"))
        lists = children.groupBy(*node).agg(F.sort_array(F.collect_list(F.struct("child", "m"))).alias("c"))  # fanout at most
        lists = lists.select(*node, F.col("c.child").alias("names"), F.col("c.m").alias("sizes"))
        named_at, same_at = same_group(node, "__p")
        paths = paths.withColumn("__node", F.floor(F.col("cell") / (width * fanout))).join(lists.withColumnsRenamed(named_at), same_at).drop(*named_at.values(), "__node")
        at = (F.array_position("names", F.floor(F.col("cell") / width)) - 1).cast("long")
        paths = paths.withColumn("path", F.concat("path", F.array(F.concat(F.array(at), F.col("sizes"))))).drop("names", "sizes")
    paths = Staged(paths, "paths").df
    at = [*keys, "cell"]
    schema = ", ".join(f"`{k}` {t}" for k, t in values.select(*keys).dtypes) + (", " if keys else "") + "sums array<double>"

    def of(group: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame({**{k: [] for k in keys}, "sums": []})
        g = group.sort_values("v")
        v, m = g["v"].to_numpy(float), g["m"].to_numpy(np.int64)
        draws, place = np.full(resamples, int(path["n"].iloc[0])), 0
        for step in path["path"].iloc[0]:
            child, children = int(step[0]), np.asarray(step[1:], float)
            rng = np.random.default_rng([1, place])
            draws = rng.multinomial(draws, children / children.sum())[:, child]
            place = place * fanout + child + 1
        rng, sums = np.random.default_rng([0, place]), []
        rows = max(1, min(256, 4_000_000 // len(v)))
        for i in range(0, resamples, rows):
            sums.append(rng.multinomial(draws[i : i + rows], m / m.sum()) @ v)
        return pd.DataFrame({**{k: [g[k].iloc[0]] for k in keys}, "sums": [np.concatenate(sums)]})

    cells = placed.select(*at, "v", "m").groupBy(*at).cogroup(paths.select(*at, "n", "path").groupBy(*at)).applyInPandas(of, schema)
    added = cells.select(*keys, F.posexplode("sums").alias("resample", "s")).groupBy(*keys, "resample").agg(F.sum("s").alias("s"))
    ends = added.groupBy(*keys).agg(F.percentile("s", F.array(F.lit(0.025), F.lit(0.975))).alias("ends")).withColumnsRenamed(named)
    whole = sizes.join(ends, same) if keys else sizes.crossJoin(F.broadcast(ends)).filter("n > 0")
    return whole.select(*keys, "n", "mean", (F.col("ends")[0] / F.col("n")).alias("low"), (F.col("ends")[1] / F.col("n")).alias("high"))


def per_model(verdicts: DataFrame, tag: str = "model_tag") -> DataFrame:
    """tag, n_total, n_scored, n_errors, axis, n, mean, low, high: a row a model and axis, NaN where an axis has no score; a NULL or empty tag is "unknown"."""
    named = verdicts.withColumn("__tag", F.coalesce(F.nullif(F.col(tag), F.lit("")), F.lit("unknown")))
    clean = F.col("error").isNull()
    counts = named.groupBy("__tag").agg(F.count("*").alias("n_total"), F.count(F.when(clean, 1)).alias("n_scored"), F.count(F.when(~clean, 1)).alias("n_errors"))
    ci = bootstrap(long_axes(named.filter(clean), ["__tag"]), ["__tag", "axis"])
    grid = counts.withColumn("axis", F.explode(F.array(*map(F.lit, AXES))))
    none = F.lit(float("nan"))
    return grid.join(ci, ["__tag", "axis"], "left").select(F.col("__tag").alias(tag), "n_total", "n_scored", "n_errors", "axis", F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(c, none).alias(c) for c in ("mean", "low", "high")])


def with_retrieval(verdicts: DataFrame, cache: DataFrame, tag: str = "model_tag") -> DataFrame:
    """Clean verdicts with the retrieval of the very output that they judge: sample and model join sample and backend of the cache.

    cache: sample_id, backend, recovered_business_ids, positive_business_id,
    output_text, output_tokens.  Verdicts whose output has no ranking or no
    positive, or that lack one of the first two scores, go.
    """
    ids, wanted = F.col("recovered_business_ids"), F.col("positive_business_id")
    known = (F.coalesce(wanted, F.lit("")) != "") & (F.coalesce(F.size(ids), F.lit(0)) > 0)
    rank = F.nullif(F.array_position(ids, wanted), F.lit(0).cast("long"))
    hit = lambda k: F.coalesce((rank <= k).cast("int"), F.lit(0)).alias(f"hit_at_{k}")
    outputs = cache.filter(known).select("sample_id", F.col("backend").alias(tag), F.coalesce(rank - 1, F.lit(-1).cast("long")).alias("rank_of_pos"), hit(1), hit(5), hit(10), F.coalesce(F.lit(1.0) / rank, F.lit(0.0)).alias("mrr"), F.length(F.coalesce("output_text", F.lit(""))).alias("output_chars"), "output_tokens")
    scored = verdicts.filter("error IS NULL AND groundedness IS NOT NULL AND personalization IS NOT NULL")
    return scored.join(outputs, ["sample_id", tag])


def agreement(paired: DataFrame, tag: str = "model_tag") -> DataFrame:
    """A row a model of :func:`with_retrieval`: retrieval, how scores go with it, and the outputs' lengths.

    n_paired, groundedness (mean), recall_at_1, _5, _10, mrr_mean; for each axis
    axis_vs_hit1 (Pearson's r with the hit at 1) and axis_vs_mrr (Spearman's rho), each
    with _p and _n, over the rows that have the axis; mean, median, 95th percentile and
    maximum of chars and tokens.  What can't be told is NULL.
    """
    known = lambda c: F.nanvl(c, F.lit(None).cast("double"))
    hit = F.col("hit_at_1").cast("double")
    r = {a: correlation(hit, F.col(a).cast("double")) for a in AXES}
    lengths = [f(f"output_{c}").alias(f"{c}_{name}") for c in ("chars", "tokens") for name, f in (("mean", F.avg), ("max", F.max))]
    basic = paired.groupBy(tag).agg(F.count("*").alias("n_paired"), F.avg("groundedness").alias("groundedness"), *[F.avg(f"hit_at_{k}").alias(f"recall_at_{k}") for k in (1, 5, 10)], F.avg("mrr").alias("mrr_mean"), *lengths, *[r[a].alias(f"{a}_vs_hit1") for a in AXES], *[F.count(a).alias(f"{a}_vs_hit1_n") for a in AXES])
    rho = rank_correlation(paired, [tag], {f"{a}_vs_mrr": (a, "mrr") for a in AXES})
    _, same = same_group([tag], "__t")
    found = basic.join(rho.withColumnRenamed(tag, "__t0"), same, "left").drop("__t0")
    for c in ("chars", "tokens"):
        at = quantiles(paired, [tag], f"output_{c}", {f"{c}_p50": 0.5, f"{c}_p95": 0.95}).withColumnsRenamed({tag: "__t0", "n": f"n_{c}"})
        found = found.join(at, same, "left").drop("__t0")
    names = [f"{a}_vs_{k}" for k in ("hit1", "mrr") for a in AXES]
    found = found.withColumns({f"{n}_n": F.coalesce(f"{n}_n", F.lit(0)) for n in names}).withColumns({f"{n}_p": known(correlation_p(n, f"{n}_n")) for n in names})
    return found.withColumns({n: known(F.col(n)) for n in names})
