"""Stored results: evaluation summaries, inference caches, and sinks."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.parsing import parse_ranking
from rankloom.functions.ranks import SLOTS, is_permutation, pick_strict

from . import documents

METRICS = "struct<`recall@1`:double,`recall@5`:double,`recall@10`:double,`mrr@10`:double,`ndcg@5`:double,`ndcg@10`:double,n_evaluated:double>"
SUMMARY = f"tag string, n_samples double, parsing struct<valid_rate:double>, positive_metrics struct<teacher:{METRICS},student:{METRICS}>, teacher_agreement struct<top1_agreement:double,kendall_tau_mean:double>, position_bias struct<slot1_top1_rate:double,chi2_uniform:double>"
ENTRY = "struct<output_text:string,parsed_ranking:array<int>,recovered_business_ids:array<string>,json_parse_ok:boolean,output_tokens:int>"
CACHE = f"backend string, samples array<struct<sample_id:string,positive_business_id:string,output_text:string,parsed_ranking:array<int>,recovered_business_ids:array<string>,json_parse_ok:boolean,output_tokens:int,by_backend:map<string,{ENTRY}>>>"

#: Bytes of a file that one task reads at most.
WHOLE_FILE = 128 << 20


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """A row a summary file: tag, the student's metrics or else the teacher's, n (zero counts as missing), agreement and bias."""
    s = spark.read.schema(SUMMARY).json(path, multiLine=True)
    m = F.coalesce("positive_metrics.student", "positive_metrics.teacher")
    return s.select("tag", F.coalesce(F.nullif(m["n_evaluated"], F.lit(0.0)), "n_samples").cast("long").alias("n"), *[m[k].alias(k) for k in ("recall@1", "recall@5", "recall@10", "mrr@10", "ndcg@5", "ndcg@10")], F.col("parsing.valid_rate").alias("parse_rate"), "teacher_agreement.*", "position_bias.*")


def slot1_rate(spark: SparkSession, path: str) -> float | None:
    """The share of top picks in slot 1 that a summary file states; None without the file or the figure."""
    try:
        row = read_summaries(spark, path).select("slot1_top1_rate").first()
    except AnalysisException:
        return None
    return row[0] if row else None


def read_cache(spark: SparkSession, paths: list[str], split: bool | None = None) -> DataFrame:
    """Long form of inference caches of both shapes; a later file overrides per sample and backend, the first positive known stays.

    Files keep the order of ``paths``, also where two folders hold files of one
    name.  A file without a list of samples is an error.  split: whether a file
    is read by many tasks at once, with the same rows; by default files of over
    WHOLE_FILE bytes are.
    """
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    whole = lambda p: hadoop.Path(p).getFileSystem(conf).makeQualified(hadoop.Path(p)).toUri().toString()
    order = F.create_map(*[F.lit(x) for i, p in enumerate(map(whole, paths)) for x in (p, i)])
    missing = lambda path: F.raise_error(F.concat(F.lit("a cache without samples: "), path))
    if any(documents.bytes_of(spark, p) > WHOLE_FILE for p in paths) if split is None else split:
        elements, shells = documents.split(spark, paths, "samples")
        sample = T._parse_datatype_string(CACHE)["samples"].dataType.elementType
        if gone := [r["path"] for r in shells.filter("shell IS NULL").limit(5).collect()]:
            raise ValueError(f"caches without samples: {', '.join(gone)}")
        backends = shells.select(F.col("path").alias("s_path"), F.from_json("shell", "backend string")["backend"].alias("backend"))  # a row a file
        s = elements.select("path", "place", F.from_json("element", sample).alias("s")).join(F.broadcast(backends), F.col("path") == F.col("s_path")).select("backend", order[F.col("path")].alias("file"), "place", "s")
    else:
        read = spark.read.schema(CACHE).json(paths, multiLine=True).withColumn("__path", F.col("_metadata.file_path"))
        listed = F.when(F.col("samples").isNull(), missing(F.col("__path")).cast(read.schema["samples"].dataType)).otherwise(F.col("samples"))
        files = read.select("backend", listed.alias("samples"), order[F.col("__path")].alias("file"))
        s = files.select("file", "backend", F.posexplode("samples").alias("place", "s"))
    alone = F.map_from_arrays(F.array(F.coalesce("backend", F.lit("unknown"))), F.array(F.struct(*[F.col(f"s.{c}") for c in ("output_text", "parsed_ranking", "recovered_business_ids", "json_parse_ok", "output_tokens")])))
    shape = F.when(F.col("backend").isNotNull() & F.col("s.by_backend").isNull(), alone).otherwise(F.col("s.by_backend"))
    rows = s.select("file", "place", "s.sample_id", "s.positive_business_id", F.explode(shape).alias("tag", "entry"))
    return union_caches(rows.select("file", "place", "sample_id", "positive_business_id", F.col("tag").alias("backend"), "entry.*"))


def valid_rankings(records: DataFrame, k: int = SLOTS) -> DataFrame:
    """Records (sample_id, error, ranking) without an error whose ranking is strict: each of 1..k once."""
    return records.filter(F.col("error").isNull() & is_permutation(F.col("ranking"), k))


def adapt_raw(raw: DataFrame, samples: DataFrame, backend: str) -> DataFrame:
    """Cache rows of one backend from raw evaluation records (sample_id, error, raw_response, positive_business_id, output_tokens).

    samples: sample_id, ids.  Records with a non-empty error go, and so do those
    of samples that aren't there; rankings are read as leniently as metrics do.
    """
    clean = raw.filter(F.coalesce("error", F.lit("")) == "")
    known = samples.select("sample_id", "ids").dropDuplicates(["sample_id"])
    text = F.coalesce("raw_response", F.lit(""))
    rows = clean.join(known, "sample_id").withColumn("output_text", text).withColumn("parsed_ranking", parse_ranking("output_text", F.size("ids")))
    return rows.select(
        "sample_id", F.lit(backend).alias("backend"), "positive_business_id", "output_text", F.coalesce("output_tokens", F.lit(0)).alias("output_tokens"), F.lit(0.0).alias("latency_sec"), F.lit(0.0).alias("ms_per_output_token"),
        "parsed_ranking", pick_strict(F.col("ids"), F.col("parsed_ranking")).alias("recovered_business_ids"), F.col("parsed_ranking").isNotNull().alias("json_parse_ok"))


def union_caches(rows: DataFrame) -> DataFrame:
    """Of rows (file, place, sample_id, positive_business_id, backend, ...) the last by file and place for each sample and backend."""
    last = Window.partitionBy("sample_id", "backend").orderBy(F.desc("file"), F.desc("place"))
    first = rows.filter("positive_business_id IS NOT NULL").groupBy("sample_id").agg(F.min_by("positive_business_id", F.struct("file", "place")).alias("positive_business_id"))
    kept = rows.withColumn("rn", F.row_number().over(last)).filter("rn = 1").drop("rn", "file", "place", "positive_business_id")
    return kept.join(first, "sample_id", "left")


def append(df: DataFrame, path: str) -> None:
    """Durable append; a job that runs again adds only what resume() leaves."""
    df.write.mode("append").parquet(path)


def write_raw(df: DataFrame, path: str) -> None:
    """JSON lines in order of index."""
    df.orderBy("index").write.option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def rewrite(df: DataFrame, path: str, version: str) -> str:
    """A new version beside the old, which stays as backup; returns the new path."""
    target = f"{path}.{version}"
    df.write.parquet(target)
    return target


def replace(df: DataFrame, path: str, version: str) -> str:
    """Write a table where another one stands, which df may have been read from: the new one is whole before the old one moves to the backup, whose path returns."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    new, old, backup = (hadoop.Path(p) for p in (f"{path}.new-{version}", path, f"{path}.bak-{version}"))
    df.write.parquet(new.toString())
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(backup):
        raise ValueError(f"there is a backup {backup} already")
    if fs.exists(old) and not fs.rename(old, backup) or not fs.rename(new, old):
        raise OSError(f"{path} could not be replaced; the new table is in {new}")
    return backup.toString()


def collected(df: DataFrame, limit: int) -> list:
    """Rows of a small result; more than the limit is an error, never a cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows")
    return rows


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small aggregated table as Markdown; more rows than the limit are an error."""
    rows = collected(df, limit)
    cell = lambda v: "—" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


def write_summary(row: dict, path: str, spark: SparkSession) -> None:
    """One JSON object with an indent of two, through the file system that the path names; NaN becomes null."""
    plain = lambda v: None if isinstance(v, float) and v != v else {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else [plain(x) for x in v] if isinstance(v, list) else v
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(json.dumps(plain(row), indent=2, ensure_ascii=False).encode()))
    finally:
        out.close()


EMPTY_VERDICTS = T.StructType([T.StructField(n, T.StringType()) for n in ("sample_id", "model_tag", "rubric_version", "error")])
