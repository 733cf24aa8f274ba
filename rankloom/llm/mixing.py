"""Mixing sources to target weights (operator 6, DataFrame functions only).

Each document gets a hash-random key.  Within a source the documents are
range-partitioned by that key into buckets of a bounded size; sums of buckets
give each bucket its offset, a window inside the bucket gives each document
its own prefix sum, and the source is cut at its exact budget.  A budget above
the size of its source repeats whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, Staged, fresh, small_or_plain, word_array

#: Rows of one key-range bucket, on average; more rows make more buckets.
BUCKET_ROWS = 4_000
#: Relative weights of the sources in order of code point, repeated.
WEIGHTS = (5, 2, 1)
#: A source is taken this many times at most.
MAX_EPOCHS = 3


def random_key(doc_id: Column, text: Column) -> Column:
    """A hash of id and text: rows of one id, or of none, fall to one key only if their texts are equal too."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit("")).cast("binary")
    return F.md5(F.concat(part(doc_id), F.lit(":").cast("binary"), F.md5(part(text)).cast("binary")))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, the hash-random key and the number of whitespace words (null text: 0)."""
    return docs.select("doc_id", "source", random_key(F.col("doc_id"), F.col("text")).alias("key"), F.size(word_array(F.col("text"), SPACES)).cast("long").alias("size"))


def targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Target of each source: the closed form of sharing by weight with caps.

    ``per_source``: source, source_size, rows; one row a source.  Sources in
    order of cap/weight stop one after the other; the level that the rest share
    follows from prefix sums, so no loop is needed.  The windows have no key:
    they run over one row a source, never over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = per_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1))
    ranked = ranked.withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
    by_ratio = Window.orderBy((F.col("cap").cast("double") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level)
    # the first source, by ratio, that the level doesn't fill to its cap sets the level for itself and all after it
    final = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap").cast("double") / F.col("weight")).alias("r"), "level"))).over(everything)
    share = F.coalesce(final["level"], F.lit(0.0)) * F.col("weight")
    return ranked.withColumn("target", F.when(final.isNull(), F.col("cap").cast("double")).otherwise(F.least(share, F.col("cap").cast("double")))).select("source", "source_size", "rows", "target")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, budget, taken: how many words of each document the mix takes.

    Null text has size 0; a null source is a source of its own; repeated rows
    are documents of their own, and equal rows may share out their words in any
    order.  Ties of the key, a hash of id and text, fall to doc_id, then size.  The document at the cut
    is taken in part, so that a source's taken words equal its rounded target.
    An empty table gives no rows.
    """
    return shares(docs, weights, max_epochs).drop("key")


def shares(docs: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """mix() with the hash-random key of each row."""
    staged = Staged(sizes(docs), "mix-sizes")
    per_source = Staged(staged.df.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "mix-sources")
    n_sources = per_source.df.count()
    goal = targets(per_source.df, weights, max_epochs).select(
        F.col("source").alias("s_source"), "source_size", "target",
        F.ceil(F.col("rows") / BUCKET_ROWS).alias("n_buckets"),
        F.least(F.floor(F.col("target") + 0.5), F.lit(max_epochs) * F.col("source_size")).cast("long").alias("budget"),
    )
    keyed = staged.df.join(small_or_plain(goal, n_sources, 200), F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
    keyed = keyed.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 4294967296.0 * F.col("n_buckets")))
    # a source that is null shares no bucket with one that is empty
    keyed = keyed.withColumns({"s_null": F.col("source").isNull(), "s_name": F.coalesce("source", F.lit(""))})
    place = ["s_null", "s_name", "bucket"]
    sums = keyed.groupBy(*place).agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("s_null", "s_name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0))).drop("bucket_size")
    within = Window.partitionBy(*place).orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.join(offsets, place).withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("budget") - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("before")))
    return placed.select("doc_id", "source", "key", "size", "source_size", "target", "budget", taken.alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The documents of which the mix takes words, with all their columns, and size and taken (under new names if docs has these).

    taken counts repeats: a document of 100 words of which 250 are taken goes in
    twice and a half.  Documents meet their share by source and key, once more
    than those only where rows are equal in id, text and source: such rows share
    out their words in any order.  Nulls, empty texts and repeated rows are as
    in :func:`mix`; an empty table gives no rows.
    """
    size, taken, k, s, n = (fresh(docs, c) for c in ("size", "taken", "__key", "__source", "__nth"))
    share = Staged(shares(docs, weights, max_epochs).select(F.col("key").alias(k), F.col("source").alias(s), F.col("size").alias(size), F.col("taken").alias(taken)), "mix").df
    held = docs.withColumn(k, random_key(F.col("doc_id"), F.col("text")))
    repeated = Staged(share.groupBy(k, s).agg(F.count("*").alias(n)).filter(F.col(n) > 1).drop(n), "mix-repeated").df
    same = lambda left, right: (left[k] == right[k]) & left["source"].eqNullSafe(right[s])
    n_repeated = repeated.count()
    wanted = share.filter(F.col(taken) > 0)
    if not n_repeated:
        return held.join(wanted, same(held, wanted)).drop(k, s)
    few = small_or_plain(repeated, n_repeated, 64)
    alike = lambda left: (left[k] == few[k]) & left[s].eqNullSafe(few[s])
    alone = wanted.join(few, alike(wanted), "left_anti")
    single = held.join(alone, same(held, alone)).drop(k, s)
    twice, parts = held.join(few, same(held, few), "left_semi"), share.join(few, alike(share), "left_semi")
    twice = twice.withColumn(n, F.row_number().over(Window.partitionBy(k, "source").orderBy(k)))
    parts = parts.withColumn(n, F.row_number().over(Window.partitionBy(k, s).orderBy(F.desc(taken)))).withColumnRenamed(n, f"{n}r")
    both = twice.join(parts, same(twice, parts) & (twice[n] == parts[f"{n}r"])).filter(F.col(taken) > 0)
    return single.unionByName(both.drop(k, s, n, f"{n}r"))


#: The same rows by one window a source.  sizes_sql: a query of doc_id, source, text.
MIX_SQL = """
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM {docs}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
      FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / w AS ratio FROM s),
l AS (SELECT a.source, a.source_size, a.w, a.cap, a.ratio,
             CAST((SELECT sum(source_size) FROM r) - coalesce((SELECT sum(b.cap) FROM r b WHERE b.ratio < a.ratio), 0) AS DOUBLE)
             / (SELECT sum(b.w) FROM r b WHERE b.ratio >= a.ratio) AS level FROM r a),
f AS (SELECT arg_min(level, ratio) AS level FROM l WHERE level * w <= cap),
t AS (SELECT l.source, l.source_size, CASE WHEN f.level IS NULL THEN CAST(l.cap AS DOUBLE) ELSE least(f.level * l.w, CAST(l.cap AS DOUBLE)) END AS target FROM l, f),
k AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             least(CAST(floor(t.target + 0.5) AS BIGINT), 3 * t.source_size) AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST, d.size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM k)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken FROM e
"""
