"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.sources.staged import Staged, remove, shared_dir, shared_path

__all__ = ["Staged", "remove", "shared_dir", "shared_path"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Separators of whitespace words; the complement is a word character.
SPACES = r"[\x20\x09-\x0D]+"
#: Separators of letter-and-digit words (all of ASCII but 0-9, A-Z, a-z).
MARKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: str.split() also splits on these, which are no separators here.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

#: Bytes up to which a checked table may be broadcast.
BROADCAST_BYTES = 64 << 20

#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1000


def words_of(text: str | None) -> list[str]:
    """Whitespace words of a text (null: none)."""
    if not text:
        return []
    return WORD.findall(text) if ODD_SPACE.search(text) else text.split()


def ascii_lower(text: str) -> str:
    """Lower-case A-Z and nothing else."""
    return text.lower() if text.isascii() else text.encode().lower().decode()  # bytes.lower() knows ASCII only


def lowered(c: Column) -> Column:
    """Column form of :func:`ascii_lower`; lower() is the fast way where all is ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def word_array(c: Column, separators: str) -> Column:
    """Words of a text column, in order (null: none)."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), separators), "")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id gives null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# --- joins and models ---------------------------------------------------------


def small_or_plain(df: DataFrame, rows: int, bytes_each: int) -> DataFrame:
    """Broadcast hint if the counted rows fit the bound; else the join shuffles both sides."""
    return F.broadcast(df) if rows * bytes_each <= BROADCAST_BYTES else df


def ship(spark: SparkSession, obj) -> Callable:
    """Broadcast an object by value, its classes included; returns a function that gives it to a task.

    A plain broadcast names classes by module, which executors need not have.
    """
    data, opened = spark.sparkContext.broadcast(cloudpickle.dumps(obj)), []

    def get():
        if not opened:
            opened.append(pickle.loads(data.value))
        return opened[0]

    return get


def prefix_sums(counts: DataFrame, group: list[str], order: str, value: str, name: str, block: int = 1024) -> DataFrame:
    """``name``: the sum of ``value`` over a group's rows before this one by ``order`` (whole numbers, one row each).

    Sums of blocks of the order come first, so that no task holds more of a
    group than a block, or than there are blocks.
    """
    b, total = fresh(counts, "__block"), fresh(counts, "__total")
    blocked = counts.withColumn(b, F.floor(F.col(order) / block))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = blocked.groupBy(*group, b).agg(F.sum(value).alias(total)).withColumn(name, F.coalesce(F.sum(total).over(before(*group, b)), F.lit(0)))
    inside = blocked.withColumn(total, F.coalesce(F.sum(value).over(before(*group, b, order)), F.lit(0)))
    return inside.join(sums.drop(total), [*group, b]).withColumn(name, F.col(name) + F.col(total)).drop(b, total)


# --- Arrow passes over texts --------------------------------------------------


def slices(batches: Iterable[pa.RecordBatch], chars: int = 8 << 20, rows: int = 4096, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches by rows and by bytes of text, so that a run of long texts doesn't fill memory; a row is never cut."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pa.compute.binary_length(b.column(text)).fill_null(0).to_pylist() if text in b.schema.names else [0] * b.num_rows
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and (total + n > chars or i - start >= rows):
                yield b.slice(start, i - start)
                start, total = i, 0
            total += n
        yield b.slice(start)


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's default, which holds ten thousand whole texts on both sides of the pipe; a session's own setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def map_texts(df: DataFrame, f: Callable[[pa.RecordBatch], dict], schema: T.StructType, **limits) -> DataFrame:
    """Apply f to slices of Arrow batches; f returns a value list or array for each column of the schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    bounded_batches(df.sparkSession)
    arrow = to_arrow_schema(schema, prefers_large_types=False)

    def run(batches):
        for b in slices(batches, **limits):
            out = f(b)
            yield pa.RecordBatch.from_arrays([x if isinstance(x := out[k.name], pa.Array) else pa.array(x, k.type, from_pandas=False) for k in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
