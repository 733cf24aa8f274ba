"""A bounded sample of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def position(doc_id: Column) -> Column:
    """A place in [0, 1) that the id alone fixes, unrelated to the crc32 that splits folds."""
    return F.conv(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def thinned(labelled: DataFrame, label: str, per_class: int) -> DataFrame:
    """Rows of each label by a fraction that leaves per_class of it, and a third more, on average.

    ``labelled`` has doc_id and the label column, not null.  One small
    aggregation gives the fractions; labels of per_class rows or less stay whole.
    """
    counts = {r[0]: r[1] for r in labelled.groupBy(label).agg(F.count("*")).collect()}
    if not counts:
        return labelled
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.33 * per_class / n))])
    return labelled.filter(position(F.col("doc_id")) < share[F.col(label)])


#: A row that holds more than this share of a class's bytes comes after all others.
LONG_SHARE = 8


def capped(rows: DataFrame, label: str, per_class: int, data: str, most: int) -> DataFrame:
    """The first per_class rows of each label, by the ids' places, as long as their data column holds no more bytes than ``most``.

    Rows of over an eighth of these bytes come last, so that a long text shuts
    out no other; a label keeps its first row whatever it holds, so none is lost.
    """
    size = F.octet_length(data)
    order = Window.partitionBy(label).orderBy(F.coalesce(size > most // LONG_SHARE, F.lit(False)), position(F.col("doc_id")), "doc_id", data)
    few = rows.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= per_class)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return few.withColumn("__bytes", F.sum(size).over(upto)).filter((F.col("__bytes") <= most) | (F.col("__rank") == 1)).drop("__rank", "__bytes")
