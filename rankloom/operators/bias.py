"""Position bias: counts by slot, chi-square against uniform, recall by the positive's slot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.ranks import SLOTS, is_permutation, slots
from rankloom.functions.stats import chi2_p


def slot_table(spark, k: int = SLOTS, name: str = "slot") -> DataFrame:
    return spark.range(1).select(F.explode(slots(k)).alias(name))


def slot_counts(df: DataFrame, slot: Column, keys: list[str] | None = None, k: int = SLOTS) -> DataFrame:
    """Counts of each slot 1..k, zero where none; with keys, for each group that has rows.  The grid is k rows a group."""
    keys = keys or []
    counts = df.select(*keys, slot.cast("int").alias("slot")).groupBy(*keys, "slot").agg(F.count("*").alias("n"))
    grid = slot_table(df.sparkSession, k)
    if keys:
        grid = counts.select(*keys).distinct().crossJoin(F.broadcast(grid))
    return grid.join(counts, [*keys, "slot"], "left").select(*keys, "slot", F.coalesce("n", F.lit(0)).alias("n"))


def chi_square(n: str = "n", k: int = SLOTS) -> Column:
    """Aggregate over one group's k counts: the statistic against uniform; NaN for no observations."""
    total = F.sum(n)
    # sum((c - e)^2 / e) with e = total / k
    return F.when(total > 0, F.sum(F.col(n).cast("double") * F.col(n)) * k / F.when(total > 0, total) - total).otherwise(F.lit(float("nan")))


def describe(counts: DataFrame, keys: list[str] | None = None, k: int = SLOTS) -> DataFrame:
    """n, the most and least chosen slot (the first of ties), their percent, the statistic and its degrees of freedom."""
    total = F.sum("n")
    percent = lambda c: F.when(total > 0, 100.0 * c / F.when(total > 0, total)).otherwise(0.0)
    return counts.groupBy(*(keys or [])).agg(
        total.alias("n_total"), F.max_by("slot", F.struct("n", -F.col("slot"))).alias("argmax"), F.min_by("slot", F.struct("n", "slot")).alias("argmin"),
        percent(F.max("n")).alias("max_percent"), percent(F.min("n")).alias("min_percent"), chi_square("n", k).alias("chi2"), F.lit(k - 1).alias("df"))


def described(counts: DataFrame, keys: list[str] | None = None, k: int = SLOTS) -> DataFrame:
    """describe() with the vectors of counts and percents by slot, the tail p and the verdict at 0.05; no observations give NaN and no verdict."""
    keys = keys or []
    vector = F.transform(F.array_sort(F.collect_list(F.struct("slot", "n"))), lambda x: x["n"])  # k entries a group
    both = describe(counts, keys, k).join(counts.groupBy(*keys).agg(vector.alias("counts")), keys) if keys else describe(counts, keys, k).crossJoin(F.broadcast(counts.agg(vector.alias("counts"))))
    percent = F.transform("counts", lambda n: 100.0 * n / F.greatest(F.col("n_total"), F.lit(1)))
    return both.withColumns({"percent": percent, "p": chi2_p("chi2", "df")}).withColumn("verdict", F.when(F.col("p") >= 0.05, "UNIFORM").when(F.col("p") < 0.05, "NON-UNIFORM"))


def matrix_tests(matrix: DataFrame, k: int = SLOTS) -> DataFrame:
    """rank_pos, chi2, df, p of each row of a rank-slot matrix against uniform, and of the whole matrix (rank_pos NULL)."""
    rows = matrix.groupBy("rank_pos").agg(chi_square("n", k).alias("chi2")).withColumn("df", F.lit(k - 1))
    whole = matrix.agg(chi_square("n", k * k).alias("chi2")).select(F.lit(None).cast("int").alias("rank_pos"), "chi2", F.lit(k * k - 1).alias("df"))
    return rows.unionByName(whole).withColumn("p", chi2_p("chi2", "df"))


def position_bias(df: DataFrame, ranking: str, gt: str, keys: list[str] | None = None, k: int = SLOTS) -> DataFrame:
    """keys, n_valid, top1_slot_counts, slot1_top1_rate, chi2_uniform, chi2_pvalue, recall_by_gt_position, recall_support: strict rankings only.

    One pass: counts by (top slot, positive's slot) are (k + 1) k rows a group.
    Recalls without support are NULL; groups without a strict ranking have no row.
    """
    keys = keys or []
    valid = df.filter(is_permutation(F.col(ranking), k)).select(*keys, F.get(ranking, F.lit(0)).cast("int").alias("top"), F.col(gt).cast("int").alias("gt"))
    cells = valid.groupBy(*keys, "top", "gt").agg(F.count("*").alias("n"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    by = [*[total(F.col("top") == s).alias(f"t{s}") for s in range(1, k + 1)], *[total(F.col("gt") == s).alias(f"g{s}") for s in range(1, k + 1)], *[total((F.col("gt") == s) & (F.col("top") == s)).alias(f"h{s}") for s in range(1, k + 1)]]
    wide = cells.groupBy(*keys).agg(F.sum("n").alias("n_valid"), *by).filter("n_valid > 0")
    array = lambda f: F.array(*[f(s) for s in range(1, k + 1)])
    squares = sum((F.col(f"t{s}").cast("double") * F.col(f"t{s}") for s in range(2, k + 1)), F.col("t1").cast("double") * F.col("t1"))
    chi2 = squares * k / F.col("n_valid") - F.col("n_valid")
    rows = wide.select(
        *keys, "n_valid", array(lambda s: F.col(f"t{s}")).alias("top1_slot_counts"), F.round(F.col("t1") / F.col("n_valid"), 4).alias("slot1_top1_rate"), chi2.alias("__chi2"),
        array(lambda s: F.round(F.col(f"h{s}") / F.nullif(F.col(f"g{s}"), F.lit(0).cast("long")), 4)).alias("recall_by_gt_position"), array(lambda s: F.col(f"g{s}")).alias("recall_support"))
    return rows.withColumns({"chi2_uniform": F.round("__chi2", 3), "chi2_pvalue": F.round(chi2_p("__chi2", F.lit(k - 1)), 6)}).drop("__chi2")


def recall_by_slot(df: DataFrame, gt: Column, top: Column, k: int = SLOTS) -> DataFrame:
    """slot, support, hits, recall (NULL without support) of top picks, by the positive's slot."""
    counts = df.select(gt.cast("int").alias("slot"), (top == gt).cast("int").alias("hit")).filter("slot IS NOT NULL").groupBy("slot").agg(F.count("*").alias("support"), F.sum("hit").alias("hits"))
    joined = slot_table(df.sparkSession, k).join(counts, "slot", "left")
    return joined.select("slot", F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("hits", F.lit(0)).alias("hits"), (F.col("hits") / F.nullif(F.col("support"), F.lit(0).cast("long"))).alias("recall"))


def rank_slot_matrix(df: DataFrame, ranking: str, k: int = SLOTS) -> DataFrame:
    """rank_pos, slot, n, percent of the row: all k x k cells, zero where none."""
    cells = df.select(F.posexplode(ranking).alias("p", "slot")).groupBy((F.col("p") + 1).alias("rank_pos"), F.col("slot").cast("int").alias("slot")).agg(F.count("*").alias("n"))
    spark = df.sparkSession
    grid = slot_table(spark, k, "rank_pos").crossJoin(slot_table(spark, k))
    full = grid.join(cells, ["rank_pos", "slot"], "left").select("rank_pos", "slot", F.coalesce("n", F.lit(0)).alias("n"))
    return full.withColumn("percent", 100.0 * F.col("n") / F.greatest(F.sum("n").over(Window.partitionBy("rank_pos")), F.lit(1)))
