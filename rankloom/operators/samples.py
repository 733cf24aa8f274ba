"""Listwise samples from visits: histories, held-out positives, negatives, candidate lists.

visits: user_id, item_id, date (ISO text, compared as text), and columns that
make the order of one user's visits total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order_stats import running

MIN_HISTORY = 8
MAX_HISTORY = 20
CANDIDATES = 10
#: Hash draws a user, out of which the unvisited make the negatives.
DRAWS = 64
#: Items listed at once for a user whose draws fall short.
RUN = 4096


def keyed(*parts: Column | str) -> Column:
    """A hash order: md5 of the parts, joined by colons."""
    return F.md5(F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]).cast("binary"))


def draw(n: Column | int, *parts) -> Column:
    """A number in 0..n-1 from the hash of the parts."""
    return (F.conv(F.substring(keyed(*parts), 1, 8), 16, 10).cast("long") % n).cast("long")


def at_least(visits: DataFrame, n: int = MIN_HISTORY) -> DataFrame:
    """Users with n visits or more, and how many; counted before anything is gathered."""
    return visits.groupBy("user_id").agg(F.count("*").alias("n_visits")).filter(F.col("n_visits") >= n)


def with_recency(visits: DataFrame, order: list[str]) -> DataFrame:
    """recency: 1 for a user's last visit by date, ties by the order's columns, later first."""
    w = Window.partitionBy("user_id").orderBy(F.desc("date"), *[F.desc(c) for c in order])
    return visits.withColumn("recency", F.row_number().over(w))


def holdout(visits: DataFrame, order: list[str], n: int = MIN_HISTORY) -> DataFrame:
    """user_id, item_id, date of each eligible user's last visit; one aggregation, combined before it shuffles."""
    last = F.max(F.struct("date", *order, F.col("item_id").alias("__item"))).alias("last")
    kept = visits.groupBy("user_id").agg(F.count("*").alias("n_visits"), last).filter(F.col("n_visits") >= n)
    return kept.select("user_id", F.col("last.__item").alias("item_id"), F.col("last.date").alias("date"))


def histories(visits: DataFrame, order: list[str], cap: int = MAX_HISTORY) -> DataFrame:
    """user_id, history: up to cap visits before the last, oldest first; the window drops the rest before anything is gathered."""
    kept = with_recency(visits, order).filter((F.col("recency") > 1) & (F.col("recency") <= cap + 1))
    return kept.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("recency")).alias("place"), "item_id", "date"))).alias("h")).select("user_id", F.transform("h", lambda x: F.struct(x["item_id"].alias("item_id"), x["date"].alias("date"))).alias("history"))


def negative_sets(users: DataFrame, visits: DataFrame, n_items: int, k: int = CANDIDATES - 1, draws: int = DRAWS) -> DataFrame:
    """user_id, items: :func:`negatives`, one row a user.

    A user's draws are one array, held against the visits where those meet by
    user; only drawn items that are visited go on, so a user's row stays short.
    """
    none = F.array().cast("array<long>")
    drawn = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda j: draw(F.lit(n_items), F.lit("n"), F.col("user_id"), j)))
    mine = users.select("user_id").distinct().withColumn("draws", drawn)
    seen = visits.select("user_id", "item_id")
    theirs = seen.select(F.col("user_id").alias("__user"), F.col("item_id").cast("long").alias("__item"))
    met = mine.join(theirs, (F.col("user_id") == F.col("__user")) & F.array_contains("draws", F.col("__item")), "left")
    left = met.groupBy("user_id").agg(F.first("draws").alias("draws"), F.collect_set("__item").alias("hit"))
    found = left.select("user_id", F.slice(F.array_except("draws", "hit"), 1, k).alias("have"))
    lacking = found.filter(F.size("have") < k)
    # runs of items, dealt out, so that no row or task holds a large catalogue
    last = F.lit(max(n_items - 1, 0)).cast("long")
    runs = lacking.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(RUN).cast("long")))).repartition("user_id", "start")
    listed = runs.select("user_id", "have", F.explode(F.sequence("start", F.least(F.col("start") + (RUN - 1), last))).alias("item_id"))
    pool = listed.filter(~F.array_contains("have", F.col("item_id"))).join(seen, ["user_id", "item_id"], "left_anti")
    w = Window.partitionBy("user_id").orderBy(keyed(F.lit("r"), "user_id", "item_id"), "item_id")
    rest = pool.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).filter(F.col("rn") + F.size("have") <= k)
    rest = rest.groupBy("user_id").agg(F.collect_list("item_id").alias("rest"))
    return found.join(rest, "user_id", "left").select("user_id", F.concat("have", F.coalesce("rest", none)).alias("items"))


def negatives(users: DataFrame, visits: DataFrame, n_items: int, k: int = CANDIDATES - 1, draws: int = DRAWS) -> DataFrame:
    """user_id, item_id: k distinct items that the user hasn't visited; users with fewer unvisited items get all of them.

    Items are numbered 0..n_items-1.  Hash draws come first.  Users whom they
    leave short get the rest from all their other unvisited items, in hash
    order.  Draws fall short where most items are visited or items are few, so
    the items listed for that are about as many as those users' visits.
    """
    return negative_sets(users, visits, n_items, k, draws).select("user_id", F.explode("items").alias("item_id"))


def candidate_lists(visits: DataFrame, order: list[str], n_items: int) -> DataFrame:
    """user_id, slot, item_id, is_positive: the positive and its negatives in hash order; users with fewer unvisited items than a list needs go."""
    positive = holdout(visits, order).select("user_id", "item_id")
    whole = negative_sets(positive, visits, n_items).filter(F.size("items") == CANDIDATES - 1)
    entry = lambda item, is_positive: F.struct(keyed(F.lit("s"), F.col("user_id"), item).alias("h"), item.alias("item_id"), F.lit(is_positive).alias("is_positive"))
    both = F.array_sort(F.concat(F.array(entry(F.col("item_id"), True)), F.transform("items", lambda x: entry(x, False))))
    rows = positive.join(whole, "user_id").select("user_id", F.posexplode(both).alias("at", "c"))
    return rows.select("user_id", (F.col("at") + 1).alias("slot"), "c.item_id", "c.is_positive")


# --- splits and samples -----------------------------------------------------------


def in_train(sample_id: Column, ratio: float = 0.9) -> Column:
    """The first 32 bits of the id's sha1, as a fraction, lie below the ratio."""
    return F.conv(F.substring(F.sha1(sample_id.cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0 < ratio


def with_ordinal(df: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """Rows numbered from 0 by a total order, without one task for all: ranges, their sizes, then ranks inside."""
    return running(df, [], order, F.lit(1), "__upto").withColumn(name, F.col("__upto") - 1).drop("__upto")


def stride(df: DataFrame, ordinal: str, n: int) -> DataFrame:
    """n rows at equal steps of the ordinal (from 0, without gaps); all rows if there are no more than n, none for n <= 0."""
    total = df.count()
    if n <= 0:
        return df.limit(0)
    step = max(1, total // n)
    return df.filter((F.col(ordinal) % step == 0) & (F.floor(F.col(ordinal) / step) < n)) if total > n else df


def cycle(df: DataFrame, ordinal: str, n: int) -> DataFrame:
    """n rows, the table's rows again and again: place from 0 and the columns of the row."""
    total = df.count()
    spark = df.sparkSession
    places = spark.range(n).select(F.col("id").alias("place"), (F.col("id") % max(total, 1)).alias("__at"))
    return places.join(df, F.col("__at") == F.col(ordinal)).drop("__at")


def perturb_seed(kind: str, sample_id: Column) -> Column:
    """First 16 hexadecimal digits of the sha256 of kind and id."""
    return F.substring(F.sha2(F.concat(F.lit(f"{kind}:"), sample_id.cast("string")).cast("binary"), 256), 1, 16)


def sample_key(user_id: Column, whole: bool = True) -> Column:
    """The sample's identifier of a user: the whole id, or (whole False) the first 16 characters, of which two users may share."""
    text = user_id.cast("string")
    return F.concat(text if whole else F.substring(text, 1, 16), F.lit("_s0"))


def first(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in file order, for which the order's columns stand; a distributed top-n."""
    return df.orderBy(*order).limit(n)


def calibration(df: DataFrame, sample_id: str, order: list, n: int) -> DataFrame:
    """The first n rows of the train split."""
    return df.filter(in_train(F.col(sample_id))).orderBy(*order).limit(n)


def random_sample(df: DataFrame, sample_id: str, n: int, seed: str = "0") -> DataFrame:
    """n rows in hash order of seed and id: the same rows on every run, whatever the partitioning."""
    return df.orderBy(keyed(F.lit(seed), sample_id), sample_id).limit(n)


def without_error(df: DataFrame, error: str = "error") -> DataFrame:
    """Rows that are good: their error is NULL (an empty text is an error)."""
    return df.filter(F.col(error).isNull())


def no_longer(df: DataFrame, length: str, most: int) -> DataFrame:
    """Rows up to a length; longer ones are dropped, never cut."""
    return df.filter(F.col(length) <= most)


def capped_users(lists: DataFrame, n: int, size: int | None = None) -> DataFrame:
    """Rows of the first n users, by id, of those who have a candidate list; with the size that all lists have, in one pass (a distributed top-n)."""
    if size is not None:
        return lists.orderBy("user_id").limit(n * size)
    first_users = lists.select("user_id").distinct().orderBy("user_id").limit(n)
    return lists.join(first_users, "user_id", "left_semi")
