"""Resumable append log as a stream (an extension; the batch form is operators.resume).

New files of a folder become rows.  What a key has come to is keyed state: a
success ends it, an error waits for a later success.  The state lives in the
state store for a stated time, so no batch reads the log again; each batch
writes a folder of its own, which the same batch, run again, writes anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

#: What a stream with keyed state of limited age needs; without the second a run to the end of the input would never end.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: How long a key is known after its last record.
MEMORY_MS = 30 * 24 * 3600 * 1000


def source(spark: SparkSession, folder: str, schema: T.StructType, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


def first_of_key(rows: DataFrame, key: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each key; state is dropped once it is older than the watermark."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def settled(rows: DataFrame, key: list[str], order: list[str] | None = None, memory_ms: int = MEMORY_MS, finished: DataFrame | None = None) -> DataFrame:
    """The records of a stream that tell something new of their key: its first success, and before that each error that differs from the last.

    Of a key's rows in one batch the success counts, the first by ``order``
    (ties, and no order, by all their values); without one the last error does.
    A key that has succeeded gives no more rows, unless it hasn't been seen for
    ``memory_ms``: then it is forgotten and counts as new.  ``finished`` holds keys
    that count as succeeded from the beginning (columns ``key``); it is read when
    the query first starts.  NULL keys are keys; state is one small row a key.
    """
    names = rows.columns
    rank = [names.index(c) for c in order or []]

    class Settle(StatefulProcessor):
        def init(self, handle) -> None:
            self.seen = handle.getValueState("seen", "done boolean, error string", memory_ms)

        def handleInputRows(self, key, rows, timerValues):
            seen = self.seen.get() if self.seen.exists() else None
            place = lambda r: (*((r[i] is not None, r[i]) for i in rank), repr(tuple(r)))
            best = wrong = None
            for r in rows:
                if r["error"] is None:
                    best = r if best is None or place(r) < place(best) else best
                else:
                    wrong = r if wrong is None or place(r) > place(wrong) else wrong
            if seen is not None and seen[0]:
                self.seen.update((True, None))  # its time begins again
            elif best is not None:
                self.seen.update((True, None))
                yield best
            elif wrong is not None:
                new = seen is None or seen[1] != wrong["error"]
                self.seen.update((False, wrong["error"]))
                if new:
                    yield wrong

        def handleInitialState(self, key, initialState, timerValues) -> None:
            self.seen.update((True, None))

    known = finished.select(*key).distinct().groupBy(*key) if finished is not None else None
    return rows.groupBy(*key).transformWithState(Settle(), rows.schema, "Append", "ProcessingTime", known)


def append_pending(rows: DataFrame, log: str, key: list[str], checkpoint: str, order: list[str] | None = None, memory_ms: int = MEMORY_MS, finished: DataFrame | None = None) -> StreamingQuery:
    """Append what :func:`settled` lets through to a log of Parquet files; a batch that runs again adds nothing.

    A batch owns the folder query=<id>/batch=<number> of the log, so running it
    again replaces its own rows; the id is the checkpoint's, so a query that
    begins with a new checkpoint (and takes the log so far as ``finished``, see
    :func:`succeeded`) has folders of its own.
    """
    spark = rows.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        batch.write.mode("overwrite").parquet(f"{log}/query={query}/batch={number}")

    before = {k: spark.conf.get(k) for k in SETTINGS}
    for k, v in SETTINGS.items():  # the stream keeps the settings that it starts with
        spark.conf.set(k, v)
    try:
        return settled(rows, key, order, memory_ms, finished).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def records(spark: SparkSession, log: str, schema: T.StructType) -> DataFrame:
    """The log's rows so far; none where there is no log yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(log)


def succeeded(log: DataFrame, key: list[str]) -> DataFrame:
    return log.filter(F.col("error").isNull()).select(*key).distinct()
