"""One huge JSON document, read by many tasks: the objects of an array in its root.

The text source cuts a file at every closing brace, so any byte range of it can
be read alone; whether such a brace stands in a string, and how deep, depends on all before
it.  Each task follows its ranges for both cases, beginning outside a string and
inside of one; folding the ranges' outcomes, a row each, tells which case
holds.  Pieces then know their depth, running counts number the objects, and the
pieces of an object meet in one row.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.order_stats import running

from .staged import Staged

ESCAPED = re.compile(r"\\.", re.S)
BRACKET = re.compile(r"[{}\[\]]")
REST_OF_STRING = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"?|[{}\[\]]', re.S)
ARRAY = re.compile(r"\s*:\s*\[")
STEP = {"{": 1, "[": 1, "]": -1, "}": -1}

EFFECTS = "path string, block long, pos long, value string, s0 boolean, d0 long, s1 boolean, d1 long, e0 boolean, f0 long, e1 boolean, f1 long"


def effect(value: str, inside: bool) -> tuple[bool, int]:
    """Whether a string is open behind a piece and its brace, and by how much the depth has changed."""
    parts = (ESCAPED.sub("", value) if "\\" in value else value).split('"')
    outside = "".join(parts[1::2] if inside else parts[::2])
    ends_inside = inside != (len(parts) % 2 == 0)
    return ends_inside, outside.count("{") + outside.count("[") - outside.count("]") - (not ends_inside)


def cut(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The pieces of the files, a closing brace behind each, with state and depth before and behind it in its range for both cases."""

    def run(batches):
        at, n, case = None, 0, []
        for b in batches:
            rows = []
            for path, block, value in zip(*[b.column(c).to_pylist() for c in ("path", "block", "value")], strict=True):
                if at != (path, block):
                    at, n, case = (path, block), 0, [(False, 0), (True, 0)]
                after = []
                for inside, depth in case:
                    ends, change = effect(value, inside)
                    after.append((ends, depth + change))
                rows.append((path, block, n, value, *case[0], *case[1], *after[0], *after[1]))
                case, n = after, n + 1
            if rows:
                kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
                fields = [f.split() for f in EFFECTS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    text = spark.read.option("lineSep", "}").text(paths)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value").mapInArrow(run, EFFECTS)


def begun(pieces: DataFrame) -> DataFrame:
    """b_path, b_block, inside, depth: how each range of a file begins; a row a range is folded."""
    last = pieces.groupBy("path", "block").agg(F.max_by(F.struct("e0", "f0", "e1", "f1"), "pos").alias("x")).select("path", "block", "x.*")

    def fold(ranges: pd.DataFrame) -> pd.DataFrame:
        inside, depth, out = False, 0, []
        for r in ranges.sort_values("block").itertuples():
            out.append((r.path, r.block, inside, depth))
            inside, depth = (r.e1, depth + r.f1) if inside else (r.e0, depth + r.f0)
        return pd.DataFrame(out, columns=["b_path", "b_block", "inside", "depth"])

    return last.groupBy("path").applyInPandas(fold, "b_path string, b_block long, inside boolean, depth long")


def opening(value: str, inside: bool, depth: int, key: str) -> int | None:
    """Where, in a piece, the array of the root's key begins: the place behind its bracket."""
    if f'"{key}"' not in value:
        return None
    at = 0
    if inside:
        rest = REST_OF_STRING.match(value)
        if not rest:
            return None
        at = rest.end()
    for t in TOKEN.finditer(value, at):
        if t[0] in STEP:
            depth += STEP[t[0]]
        elif depth == 1 and t[0] == f'"{key}"' and (m := ARRAY.match(value, t.end())):
            return m.end()
    return None


def closing(value: str, inside: bool, depth: int, start: int) -> int | None:
    """Where, in a piece from ``start`` on, the depth first falls below that of the root's arrays."""
    if "]" not in value:
        return None
    at = start
    if inside and not start:
        rest = REST_OF_STRING.match(value)
        if not rest:
            return None
        at = rest.end()
    for t in TOKEN.finditer(value, at):
        depth += STEP.get(t[0], 0)
        if depth < 2 and t[0] == "]":
            return t.start()
    return None


def split(spark: SparkSession, paths: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """The objects of the array ``key`` in the root of each file, and the files without them.

    Returns (path, place, element), place from 0 and element the object's text,
    and (path, shell): the document with that array empty, NULL where there is no such array.
    The array holds objects only; the rest of a document has to fit a row.
    Of a key that comes twice the first counts.
    """
    pieces = Staged(cut(spark, paths), "pieces").df
    starts = Staged(begun(pieces), "ranges").df  # a row a range: as many as the source has splits
    met = pieces.join(F.broadcast(starts) if starts.count() <= 100_000 else starts, (F.col("path") == F.col("b_path")) & (F.col("block") == F.col("b_block")))
    own = lambda a, b: F.when(F.col("inside"), F.col(b)).otherwise(F.col(a))
    placed = met.select("path", "block", "pos", "value", own("s0", "s1").alias("open"), (F.col("depth") + own("d0", "d1")).alias("before"), own("e0", "e1").alias("ends_open"), (F.col("depth") + own("f0", "f1")).alias("after"))

    def run(batches):
        for b in batches:
            found, shut = [], []
            for value, inside, depth in zip(*[b.column(c).to_pylist() for c in ("value", "open", "before")], strict=True):
                start = opening(value, inside, depth, key)
                found.append(start)
                shut.append(closing(value, inside, 2 if start is not None else depth, start or 0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int32()), pa.array(shut, pa.int32())], names=[*b.schema.names, "start", "shut"])

    seen = Staged(placed.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in placed.dtypes) + ", start int, shut int"), "seen").df
    at = F.struct("block", "pos")
    first = seen.filter("start IS NOT NULL").groupBy(F.col("path").alias("o_path")).agg(F.min(at).alias("opened"))
    with_first = seen.join(F.broadcast(first), F.col("path") == F.col("o_path"), "left")  # a row a file
    last = with_first.filter((at >= F.col("opened")) & F.col("shut").isNotNull()).groupBy(F.col("path").alias("c_path")).agg(F.min(at).alias("closed"))
    known = with_first.join(F.broadcast(last), F.col("path") == F.col("c_path"), "left")
    known = Staged(known.select("path", "block", "pos", "value", "start", "shut", "after", "ends_open", (at < F.col("opened")).alias("ahead"), (at == F.col("opened")).alias("opens"), (at == F.col("closed")).alias("closes"), (at > F.col("closed")).alias("behind")), "known").df
    inside = known.filter("NOT ahead AND NOT closes AND NOT behind").withColumn("value", F.when(F.col("opens"), F.expr("substr(value, start + 1)")).otherwise(F.col("value")))
    inside = inside.select("path", "block", "pos", "value", (~F.col("ends_open") & (F.col("after") == 2)).cast("long").alias("ends"))
    numbered = running(inside, ["path"], ["block", "pos"], F.col("ends"), "upto").withColumn("place", F.col("upto") - F.col("ends"))
    whole = numbered.groupBy("path", "place").agg(F.sort_array(F.collect_list(F.struct("block", "pos", "value"))).alias("p"), F.max("ends").alias("ended")).filter("ended = 1")
    elements = whole.select("path", "place", F.regexp_replace(F.concat(F.array_join(F.col("p.value"), "}"), F.lit("}")), r"\A[\s,]+", "").alias("element"))
    head = F.when(F.col("opens"), F.concat(F.expr("substr(value, 1, start)"), F.lit("]"))).otherwise(F.lit(""))
    tail = F.when(F.col("closes"), F.expr("substr(value, shut + 2)")).otherwise(F.when(F.col("ahead") | F.col("behind"), F.col("value")).otherwise(F.lit("")))
    # what follows the root's own brace has none behind it
    brace = F.when((F.col("ahead") | F.col("closes") | F.col("behind")) & (F.col("after") >= 0), F.lit("}")).otherwise(F.lit(""))
    outer = known.filter("ahead OR opens OR closes OR behind").select("path", "block", "pos", F.concat(head, tail, brace).alias("text"))
    shells = outer.groupBy("path").agg(F.array_join(F.sort_array(F.collect_list(F.struct("block", "pos", "text")))["text"], "").alias("shell"))
    return elements, seen.select("path").distinct().join(shells, "path", "left")


def bytes_of(spark: SparkSession, path: str) -> int:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return int(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength())

