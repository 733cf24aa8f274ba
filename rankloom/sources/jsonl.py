"""JSON-lines sources: three ways with bad lines, and keyed loads."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.parsing import is_json
from rankloom.functions.text import stripped

BAD = "_bad_line"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines that aren't blank."""
    return spark.read.text(path).filter(stripped(F.col("value")) != "")


def parse(text: DataFrame, schema: T.StructType, mode: str = "skip", column: str = "value") -> DataFrame:
    """Rows of JSON text.  mode: "keep" (bad lines stay, in BAD), "skip" (they go) or "strict" (one is an error).

    A line is bad if it isn't strict JSON; text behind an object makes it bad
    too, which from_json alone lets pass.
    """
    wide = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    rows = text.withColumn("__ok", is_json(column)).withColumn("__r", F.from_json(column, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}))
    wrong = ~F.col("__ok") | F.col(f"__r.{BAD}").isNotNull()
    if mode == "strict":
        rows = rows.withColumn("__r", F.when(wrong, F.raise_error(F.concat(F.lit("not a JSON record: "), F.substring(column, 1, 80))).cast(wide)).otherwise(F.col("__r")))
        return rows.select(*[f"__r.{f.name}" for f in schema])
    if mode == "skip":
        return rows.filter(~wrong).select(*[f"__r.{f.name}" for f in schema])
    return rows.select(*[F.when(~wrong, F.col(f"__r.{f.name}")).alias(f.name) for f in schema], F.when(wrong, F.col(column)).alias(BAD))


def read(spark: SparkSession, path: str, schema: T.StructType, mode: str = "skip", missing_ok: bool = False) -> DataFrame:
    """JSON lines of a path; a path that isn't there is an empty table if missing_ok."""
    try:
        return parse(lines(spark, path), schema, mode)
    except AnalysisException:
        if not missing_ok:
            raise
        return spark.createDataFrame([], schema)


def last_wins(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row of each key, by an order that must be total; rows with a NULL or empty key go."""
    w = Window.partitionBy(*key).orderBy(*order)
    held = df
    for k in key:
        held = held.filter(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    return held.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def shard(df: DataFrame, ordinal: str, index: int, total: int) -> DataFrame:
    """Rows whose ordinal over the whole input falls to a shard."""
    if not 0 <= index < total:
        raise ValueError(f"shard {index} of {total}")
    return df.filter(F.pmod(F.col(ordinal), F.lit(total)) == index)
