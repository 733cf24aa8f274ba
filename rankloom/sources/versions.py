"""Tables that are replaced as a whole: versions beside each other, and one small file that names the current one.

A version is written first, whole; then a file with its name is written under
another name and moved over the pointer, the only step that readers notice.  So
a reader sees the old table or the new one at any moment, and after a crash
between any two steps too.  A version stays readable until :func:`prune`.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "_current.json"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _move_over(spark: SparkSession, source: str, target: str) -> None:
    """Rename that replaces the target in one step."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    hadoop = jvm.org.apache.hadoop.fs
    kind = hadoop.Options.Rename
    options = gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    a, b = hadoop.Path(source), hadoop.Path(target)
    hadoop.FileContext.getFileContext(b.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(a, b, options)


def _pointer(spark: SparkSession, table: str) -> dict:
    fs, p = _fs(spark, f"{table}/{POINTER}")
    if not fs.exists(p):
        return {}
    stream = fs.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(df: DataFrame, table: str, version: str | None = None) -> str:
    """Write df as the table's new version and make it the current one; df may have been read from the table.

    Returns the version's name.  Writers don't wait for each other: the last to
    move the pointer wins, and the other's version stays beside it.
    """
    spark = df.sparkSession
    version = version or uuid.uuid4().hex
    fs, p = _fs(spark, f"{table}/version={version}")
    if fs.exists(p):
        raise ValueError(f"{table} has a version {version} already")
    df.write.parquet(p.toString())
    before = _pointer(spark, table).get("version")
    new = f"{table}/_next-{uuid.uuid4().hex}"
    _write(spark, new, json.dumps({"version": version, "before": before}))
    _move_over(spark, new, f"{table}/{POINTER}")
    return version


def current(spark: SparkSession, table: str) -> DataFrame:
    """The table as it is now; what is read stays that version however often the table is replaced."""
    found = _pointer(spark, table)
    if not found:
        raise ValueError(f"{table} has no version yet")
    return at_version(spark, table, found["version"])


def at_version(spark: SparkSession, table: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{table}/version={version}")


def before(spark: SparkSession, table: str) -> str | None:
    """The version that the current one replaced."""
    return _pointer(spark, table).get("before")


def prune(spark: SparkSession, table: str, keep: int = 1) -> list[str]:
    """Remove what no pointer names: versions but the current one and the ``keep`` last before it by time, and what crashes left; returns the versions removed.

    Not while a version is being written or read elsewhere.
    """
    fs, p = _fs(spark, table)
    now = _pointer(spark, table)
    found = sorted(((f.getModificationTime(), f.getPath().getName(), f.getPath()) for f in fs.listStatus(p)), key=lambda x: x[:2])
    named = {f"version={v}" for v in now.values() if v}
    versions = [x for x in found if x[1].startswith("version=")]
    older = [x for x in versions if x[1] != f"version={now.get('version')}"]
    kept = {x[1] for x in older[len(older) - keep :]} if keep else set()
    gone = [x for x in older if x[1] not in kept and (not keep or x[1] not in named)]
    for _, _, path in [*gone, *[x for x in found if x[1].startswith("_next-")]]:
        fs.delete(path, True)
    return [x[1].removeprefix("version=") for x in gone]
