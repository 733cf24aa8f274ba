"""Benchmark decontamination by size-partitioned MinHash containment (operator 10, DataFrame functions only).

Words are runs of letters and digits, A-Z lower-cased; shingles are five words
(a shorter item is one shingle, looked for at every place of a text).  Of an item with n distinct shingles a
document may lack n - ceil(0.8 n), so of any n - ceil(0.8 n) + 1 of them it
holds at least one.  Items are partitioned by size, and each partition keeps as
MinHash sketch the smallest hashes of its items' shingles (rare ones first), as
many as that bound asks of its largest item.  So the search, unlike banded MinHash, whose
Jaccard similarity vanishes for a short item inside a long document, loses no
pair at any size.  A document is a candidate for an item if it holds a value of
the item's sketch; candidates are verified by exact containment, on the shingles
themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MARKS, Staged, fresh, lowered, small_or_plain, word_array

SHINGLE = 5
CONTAINMENT = 0.8


def shingles(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, n_words, shingle: one row for each place of a shingle; texts without a word have none."""
    words = df.select(*key, word_array(lowered(F.col(text)), MARKS).alias("words")).withColumn("n_words", F.size("words"))
    rolling = [F.slice("words", i + 1, F.greatest(F.col("n_words") - (SHINGLE - 1), F.lit(1))) for i in range(SHINGLE)]
    gram = words.select(*key, "n_words", F.inline(F.arrays_zip(*[c.alias(f"w{i}") for i, c in enumerate(rolling)])).alias(*[f"w{i}" for i in range(SHINGLE)]))
    return gram.select(*key, "n_words", F.concat_ws(" ", *[f"w{i}" for i in range(SHINGLE)]).alias("shingle"))


def document_shingles(df: DataFrame, widths: list[int]) -> DataFrame:
    """doc_id, shingle: runs of words of each width (1 to 5), one row for each place."""
    words = df.select("doc_id", word_array(lowered(F.col("text")), MARKS).alias("words"))
    found = None
    for n in widths:
        # a shorter text gives empty slices; a filter would split it twice
        rolling = [F.slice("words", i + 1, F.greatest(F.size("words") - (n - 1), F.lit(0))).alias(f"w{i}") for i in range(n)]
        runs = words.select("doc_id", F.inline(F.arrays_zip(*rolling)).alias(*[f"w{i}" for i in range(n)]))
        runs = runs.select("doc_id", F.concat_ws(" ", *[f"w{i}" for i in range(n)]).alias("shingle"))
        found = runs if found is None else found.unionByName(runs)
    return found


def needed(n: Column) -> Column:
    """Shingles that a document must hold of n: the smallest whole number of at least 0.8 n."""
    return F.floor((n * 4 + 4) / 5).cast("long")


def item_shingles(items: DataFrame) -> DataFrame:
    """item_id, shingle, hash, n_item, size_class, rank; equal rows of a benchmark count once, rows of one id are one item.

    rank is the place in the item's sketch: shingles of the fewest items first,
    then the smallest hashes.  Any order keeps the search whole; this one keeps
    phrases that many items share (and many documents, then) out of sketches.
    """
    distinct = shingles(items, ["item_id"]).select("item_id", "shingle").distinct()
    common = distinct.groupBy("shingle").agg(F.count("*").alias("shared_by"))
    own = Window.partitionBy("item_id")
    sized = distinct.join(common, "shingle").withColumn("hash", F.xxhash64("shingle")).withColumn("n_item", F.count("*").over(own))
    ranked = sized.withColumn("rank", F.row_number().over(own.orderBy("shared_by", "hash", "shingle")))
    return ranked.withColumn("size_class", F.floor(F.log2("n_item")).cast("int")).drop("shared_by")


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment: every pair with containment of at least 0.8.

    Texts without words (null, empty) are in no pair, nor contain anything.
    Rows of one doc_id count as one document, rows with a null doc_id too; rows
    of one item_id as one item.  An item of fewer than five words is one shingle
    of its own length, which every document that has these words in a row holds.
    Empty tables give no rows.
    """
    grams = Staged(item_shingles(items), "items")
    # each size class: the longest sketch any of its items needs
    classes = grams.df.groupBy("size_class").agg(F.max(F.col("n_item") - needed(F.col("n_item")) + 1).alias("sketch"))
    n_grams = grams.df.count()
    probe = grams.df.join(F.broadcast(classes), "size_class").filter("rank <= sketch").select("hash", "item_id")  # a row a power of two, at most
    # an item's rows of one id may differ in length, so widths are those of the shingles
    widths = [r["width"] for r in grams.df.select(F.size(F.split("shingle", " ")).alias("width")).distinct().orderBy("width").collect()]  # five at most
    text = docs.select("doc_id", "text")
    places = document_shingles(text, widths or [SHINGLE]).select("doc_id", F.xxhash64("shingle").alias("hash"))
    hits = places.join(small_or_plain(probe, n_grams, 32), "hash")
    pairs = Staged(hits.select("doc_id", "item_id").distinct(), "candidates")
    found = pairs.df.select(F.col("doc_id").alias("c_doc")).distinct()
    n_found = found.count()
    suspects = text.join(small_or_plain(found, n_found, 16), F.col("doc_id").eqNullSafe(F.col("c_doc")), "left_semi")
    # exact verification of candidate pairs, which meet their item's shingles before those of the text
    own = small_or_plain(grams.df.select(F.col("item_id").alias("g_item"), "shingle", "n_item"), n_grams, 128)
    wanted = pairs.df.join(own, F.col("item_id").eqNullSafe(F.col("g_item"))).select(F.col("doc_id").alias("c_doc"), "item_id", "n_item", F.col("shingle").alias("c_shingle"))
    wanted = Staged(wanted, "candidate-shingles").df
    met = document_shingles(suspects, widths or [SHINGLE]).join(small_or_plain(wanted, wanted.count(), 160), F.col("doc_id").eqNullSafe(F.col("c_doc")) & (F.col("shingle") == F.col("c_shingle")))
    shared = met.select("doc_id", "item_id", "n_item", "shingle").distinct()
    counts = shared.groupBy("doc_id", "item_id", "n_item").agg(F.count("*").alias("n_shared"))
    return counts.filter(F.col("n_shared") >= needed(F.col("n_item"))).select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that contain no item, with all their columns, whatever these are called.

    Rows of one doc_id (null ids too) are one document: they stay or go
    together.  Null and empty texts stay, and so does all without items; an
    empty table gives no rows.
    """
    name = fresh(docs, "__dirty")
    dirty = Staged(contained(docs, items).select("doc_id").distinct().withColumnRenamed("doc_id", name), "dirty")
    n = dirty.df.count()
    return docs.join(small_or_plain(dirty.df, n, 16), docs["doc_id"].eqNullSafe(F.col(name)), "left_anti")


ORACLE_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
v AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 4), ' ') AS shingle FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM v WHERE len(w) > 0)),
widths AS (SELECT DISTINCT least(len(w), 5) AS n FROM v WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + n - 1), ' ') AS shingle FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w JOIN widths ON n <= len(w))),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, CAST(count(*) AS DOUBLE) / n_item AS containment
FROM ds JOIN bs USING (shingle) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING count(*) * 5 >= n_item * 4
"""
