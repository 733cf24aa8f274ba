"""Two passes over one sample, merged by Borda counts; and stored summaries that get metrics they lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import ranks

#: Metrics of a summary, and those that a summary may lack.
METRICS = ["recall@1", "recall@5", "recall@10", "mrr@10", "ndcg@5", "ndcg@10", "n_evaluated"]
GAINS = ["ndcg@5", "ndcg@10"]


def merge_records(first: DataFrame, second: DataFrame, k: int = ranks.SLOTS) -> DataFrame:
    """One record a sample that both passes rank strictly: the first's columns, the merged ranking, and how far the passes agree.

    first: sample_id, ranking and whatever else is to stay; second: sample_id,
    ranking (of the slots as that pass saw them), permutation (which slots it
    saw).  merge: both rankings in the original slots, points, top-1 agreement
    and Kendall's tau to four digits.
    """
    shown = second.filter(ranks.is_permutation(F.col("ranking"), k)).select("sample_id", "permutation", ranks.compose(F.col("ranking"), F.col("permutation")).alias("__second"))
    both = first.filter(ranks.is_permutation(F.col("ranking"), k)).join(shown, "sample_id")
    a, b = F.col("ranking"), F.col("__second")
    merge = F.struct(
        F.lit("borda_count_k=2").alias("method"), a.alias("pass1_ranking"), b.alias("pass2_ranking_original_space"), F.col("permutation").alias("pass2_permutation"), ranks.borda_scores(a, b, k).alias("borda_scores"),
        (F.get(a, F.lit(0)) == F.get(b, F.lit(0))).alias("top1_agreement"), F.round(ranks.kendall_tau(a, b, k), 4).alias("kendall_tau"))
    return both.withColumns({"merge": merge, "__merged": ranks.borda_merge(a, b, k)}).drop("ranking", "permutation", "__second").withColumnRenamed("__merged", "ranking")


def retrieval(rank: Column) -> list[Column]:
    """Aggregates of METRICS over the ranks of positives; a NULL rank counts as a miss, and the mean is over all rows."""
    values = [ranks.hit_at(rank, 1), ranks.hit_at(rank, 5), ranks.hit_at(rank, 10), ranks.reciprocal(rank), ranks.gain_at(rank, 5), ranks.gain_at(rank, 10)]
    return [*[F.avg(v).alias(m) for v, m in zip(values, METRICS, strict=False)], F.count("*").cast("double").alias(METRICS[-1])]


def backfill(summaries: DataFrame, raw: DataFrame, samples: DataFrame) -> DataFrame:
    """summaries (tag, student, teacher: map of metric to value) with status and, where the student lacks a gain, its metrics from the raw rankings.

    raw: tag, sample_id, ranking, positive; samples: sample_id, ids, positive
    (it goes before the raw one).  status: skipped_no_raw, already_has_ndcg or
    updated, the first that holds.  New values replace the student's old ones,
    other metrics stay, the teacher's aren't touched.  A sample that isn't
    known, and a ranking that isn't strict, count as misses.
    """
    known = samples.select("sample_id", "ids", F.nullif(F.col("positive"), F.lit("")).alias("__positive"))
    rows = raw.join(known, "sample_id", "left")
    rank = ranks.rank_of(ranks.pick_strict(F.col("ids"), F.col("ranking")), F.coalesce("__positive", "positive"))
    new = rows.withColumn("__rank", rank).groupBy("tag").agg(*retrieval(F.col("__rank")))
    new = new.select("tag", F.map_from_arrays(F.array(*map(F.lit, METRICS)), F.array(*[F.col(f"`{m}`") for m in METRICS])).alias("__new"))
    joined = summaries.join(new, "tag", "left")
    had = F.coalesce("student", F.create_map().cast("map<string,double>"))
    has = F.map_contains_key(had, GAINS[0]) & F.map_contains_key(had, GAINS[1])
    status = F.when(F.col("__new").isNull(), "skipped_no_raw").when(has, "already_has_ndcg").otherwise("updated")
    merged = F.map_concat(F.map_filter(had, lambda m, _: ~F.map_contains_key(F.col("__new"), m)), "__new")
    return joined.withColumn("status", status).withColumn("student", F.when(F.col("status") == "updated", merged).otherwise(F.col("student"))).drop("__new")
