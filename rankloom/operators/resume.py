"""Work lists: what is left to do, what is missing, what belongs to nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: Rows up to which a table is crossed with samples by a copy on every task.
FEW = 10_000


def short(df: DataFrame) -> DataFrame:
    """A hint to copy a table to every task, once counting shows that it is short; a long one is crossed by a shuffle of both sides."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def pending(todo: DataFrame, log: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key has no record without an error in the log."""
    return todo.join(log.filter("error IS NULL").select(*key).distinct(), key, "left_anti")


def work_list(samples: DataFrame, models: DataFrame, log: DataFrame, key: list[str]) -> DataFrame:
    """Every sample for every model, less what is done."""
    return pending(samples.crossJoin(short(models)), log, key)


def judge_list(samples: DataFrame, models: DataFrame, cache: DataFrame, log: DataFrame, parsed: str = "parsed") -> DataFrame:
    """sample_id, model_tag, status of what a judge is asked: done, no_output, unparseable or pending, the first that holds.

    cache: sample_id, model_tag and the parsed output (NULL where it didn't
    parse).  Only pending pairs are sent; the rest are there to be counted.
    """
    done = log.filter("error IS NULL").select("sample_id", "model_tag").distinct().withColumn("__done", F.lit(True))
    have = cache.select("sample_id", "model_tag", F.col(parsed).isNotNull().alias("__parsed")).groupBy("sample_id", "model_tag").agg(F.max("__parsed").alias("__parsed"))
    every = samples.select("sample_id").crossJoin(short(models.select("model_tag"))).join(done, ["sample_id", "model_tag"], "left").join(have, ["sample_id", "model_tag"], "left")
    status = F.when(F.col("__done"), "done").when(F.col("__parsed").isNull(), "no_output").when(~F.col("__parsed"), "unparseable").otherwise("pending")
    return every.select("sample_id", "model_tag", status.alias("status"))


def grid(*sides: DataFrame) -> DataFrame:
    """Every combination of the rows of several tables, the first of which may be long."""
    out = sides[0]
    for side in sides[1:]:
        out = out.crossJoin(short(side))
    return out


def require(wanted: DataFrame, have: DataFrame, key: list[str], what: str) -> None:
    """An error that names the first five wanted keys that aren't there, and how many; at most six rows reach the driver."""
    gone = missing(wanted, have, key)
    few = [tuple(r) if len(key) > 1 else r[0] for r in gone.orderBy(*key).limit(5).collect()]
    if few:
        raise ValueError(f"{gone.count()} {what} are missing, the first: {few}")


def observed(df: DataFrame, name: str, error: str = "error") -> tuple[DataFrame, Observation]:
    """The rows with counters that fill while an action runs over them: ok, failed, rate of success.  No pass of its own."""
    seen = Observation(name)
    ok = F.count(F.when(F.col(error).isNull(), 1))
    return df.observe(seen, ok.alias("ok"), F.count(error).alias("failed"), (ok / F.greatest(F.count("*"), F.lit(1))).alias("rate")), seen


def missing(wanted: DataFrame, have: DataFrame, key: list[str]) -> DataFrame:
    """Distinct wanted keys that aren't there."""
    return wanted.select(*key).distinct().join(have.select(*key), key, "left_anti")


def classified(teacher: DataFrame, samples: DataFrame, invalid: str, key: str = "sample_id") -> DataFrame:
    """Teacher rows with status: preexisting_error, no_sample, invalid (an SQL condition) or kept; the first that holds."""
    known = samples.select(key).distinct().withColumn("__known", F.lit(True))
    status = F.when(F.col("error").isNotNull(), "preexisting_error").when(F.col("__known").isNull(), "no_sample").when(F.expr(invalid), "invalid").otherwise("kept")
    return teacher.join(known, key, "left").withColumn("status", status).drop("__known")


def with_shares(counts: DataFrame, count: str = "n") -> DataFrame:
    """A small table of counts with each count's share of all."""
    total = counts.agg(F.sum(count).alias("__all"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col(count) / F.col("__all")).drop("__all")
