"""Ranked lexical search by a threshold-seeded join (operator 12).

The index keeps a row a document: its query terms with their impacts, whole
numbers whose sums are scores; and for each term the documents of its k
greatest impacts.  An item's k-th score is at least the k-th impact of any of
its terms, and at least the k-th exact score among the documents stored with
its terms: that is its threshold.  Terms with the smallest greatest impacts are
pruned while their sum (the suffix bound) stays under a share of the
threshold: a document without any other term can't reach it.  Joining the
other terms with the index gives candidates; one whose sum and suffix bound
together miss the threshold is dropped, the rest are scored exactly, over all
terms of the item, and ranked.  Nothing that could be among the k is lost, ties
with the threshold included.

Items are searched in blocks of a bounded number of terms, so that what tasks
get of them is bounded, each block against all documents.  A document's terms
lie in one row, so the join of candidates needs no shuffle; the ranking gets k
rows an item from each partition at most.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MARKS, Staged, ascii_lower, bounded_batches, lowered, prefix_sums, ship, slices, small_or_plain, word_array

K = 10
#: Terms of a block of items, counted once an item; an item of more is a block of its own.
BLOCK_TERMS = 300_000
#: Terms are pruned while their bounds sum to less than this share of the threshold.
PRUNED_SHARE = 0.6
#: Cells (documents times items) that a task sums at once.
CELLS = 4 << 20

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
INDEX = "doc_id long, n long, terms array<int>, impacts array<long>"
FOUND = "item int, doc_id long, score long"


# --- items ---------------------------------------------------------------------


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, number, term: distinct terms of each item; rows of one item_id (null too) are one item, numbered from 0."""
    words = items.select("item_id", F.explode(F.array_distinct(word_array(lowered(F.col("text")), MARKS))).alias("term")).distinct()
    counted = Staged(words.groupBy("item_id").agg(F.count("*").alias("n_terms")).withColumns({"part": F.monotonically_increasing_id()}), "items").df
    # blocks: an item belongs to that in which its first term falls, by the sum of terms before it
    blocked = prefix_sums(counted.withColumn("all", F.lit(0)), ["all"], "part", "n_terms", "before").withColumn("block", F.floor(F.col("before") / BLOCK_TERMS))
    blocked = blocked.select(F.col("item_id").alias("b_id"), "part", "block")
    n_items = counted.count()
    return words.join(small_or_plain(blocked, n_items, 64), F.col("item_id").eqNullSafe(F.col("b_id"))).select("item_id", "part", "block", "term")


class Block:
    """Items of one block: names, and (item, term) numbers sorted by term; vocabulary: term to number."""

    def __init__(self, rows: list):
        self.names: list = []
        self.vocabulary: dict[str, int] = {}
        numbers: dict[int, int] = {}
        pairs = []
        for r in rows:
            if r["part"] not in numbers:
                numbers[r["part"]] = len(self.names)
                self.names.append(r["item_id"])
            pairs.append((self.vocabulary.setdefault(r["term"], len(self.vocabulary)), numbers[r["part"]]))
        self.term, self.item = np.array(sorted(pairs), np.int64).reshape(-1, 2).T


# --- the index -------------------------------------------------------------------


def term_counts(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """doc_id, n, terms, counts of every row: the number of its terms with repeats, and how often it holds which of the vocabulary."""
    spark = docs.sparkSession
    known = ship(spark, vocabulary)
    bounded_batches(spark)

    def run(batches):
        numbers = known()
        for b in slices(batches):
            n, offsets, terms, counts = [], [0], [], []
            for text in b.column("text").to_pylist():
                words = TERM.findall(ascii_lower(text)) if text else []
                n.append(len(words))
                held = sorted((numbers[w], c) for w, c in Counter(words).items() if w in numbers)
                terms += [x[0] for x in held]
                counts += [x[1] for x in held]
                offsets.append(len(terms))
            where = pa.array(offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(where, pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


def impact_index(counts: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """row, doc_id, terms, impacts: weight * ((10**9 * tf) div (1000 * tf + 8 * m)) in 64-bit whole numbers; impacts of 0 add nothing and have no place."""
    shipped = ship(counts.sparkSession, weights)

    def run(batches):
        weight = shipped()
        for b in batches:
            flat, where, row = flattened(b, "terms")
            tf = b.column("counts").flatten().to_numpy(zero_copy_only=False)
            m = 10 + (90 * b.column("n").to_numpy() * n_docs) // n_terms
            impact = weight[flat] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
            kept = impact > 0
            where = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=b.num_rows))])
            lists = [pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(x[kept], kind)) for x, kind in ((flat, pa.int32()), (impact, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n"), *lists], names=["doc_id", "n", "terms", "impacts"])

    held = counts.filter(F.size("terms") > 0).mapInArrow(run, INDEX)
    return held.filter(F.size("terms") > 0).drop("n").withColumn("row", F.monotonically_increasing_id())


def flattened(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a list column one after the other, where each list begins, and the row of each value."""
    offsets = b.column(name).offsets.to_numpy()
    where = offsets - offsets[0]
    return b.column(name).flatten().to_numpy(zero_copy_only=False), where, np.repeat(np.arange(b.num_rows), np.diff(where))


def greatest(index: DataFrame, k: int) -> DataFrame:
    """term, impact, row: each term's k greatest impacts and their documents.  A task keeps no more than these, so no term's postings meet."""

    def best(term, impact, row):
        order = np.lexsort((row, -impact, term))
        term, impact, row = term[order], impact[order], row[order]
        first = np.searchsorted(term, term)
        kept = np.arange(len(term)) - first < k
        return term[kept], impact[kept], row[kept]

    def run(batches):
        held, pending = (np.zeros(0, np.int64),) * 3, []
        for b in batches:
            flat, _, row = flattened(b, "terms")
            pending.append((flat.astype(np.int64), b.column("impacts").flatten().to_numpy(zero_copy_only=False), b.column("row").to_numpy()[row]))
            if sum(len(x[0]) for x in pending) > 1_000_000:
                held, pending = best(*map(np.concatenate, zip(held, *pending, strict=True))), []
        held = best(*map(np.concatenate, zip(held, *pending, strict=True))) if pending else held
        for i in range(0, len(held[0]), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 10_000]) for x in held], names=["term", "impact", "row"])

    first = Window.partitionBy("term").orderBy(F.desc("impact"), "row")
    mine = index.select("row", "terms", "impacts").mapInArrow(run, "term long, impact long, row long")
    return mine.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k)


# --- thresholds ---------------------------------------------------------------------


def seeds(index: DataFrame, top: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """item, score: the k-th exact score among the documents stored with an item's terms, where there are k."""
    near = Staged(pairs.join(F.broadcast(top.select("term", "row")), "term").select("item", "row").distinct(), "seeds").df  # k rows a term of the block
    whole = index.join(small_or_plain(near, near.count(), 16), "row").select("item", "row", F.explode(F.arrays_zip("terms", "impacts")).alias("x"))
    own = whole.select("item", "row", F.col("x.terms").cast("long").alias("term"), F.col("x.impacts").alias("impact")).join(F.broadcast(pairs), ["item", "term"])
    scored = own.groupBy("item", "row").agg(F.sum("impact").alias("score"))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "row"))).filter(F.col("place") == k).select("item", "score")


def essential(block: Block, highest: np.ndarray, threshold: np.ndarray, share: float = PRUNED_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Which (item, term) pairs of the block aren't pruned, and each item's suffix bound: the sum of its pruned terms' greatest impacts."""
    order = np.lexsort((highest[block.term], block.item))
    item, bound = block.item[order], highest[block.term[order]]
    total = np.cumsum(bound)
    begin = np.searchsorted(item, item)  # the first of the item's pairs
    within = total - (total - bound)[begin]
    pruned = within < share * threshold[item]
    kept = np.ones(len(item), bool)
    kept[order] = ~pruned
    return kept, np.bincount(item, np.where(pruned, bound, 0), len(threshold)).astype(np.int64)


def candidates(index: DataFrame, block: Block, kept: np.ndarray, rest: np.ndarray, threshold: np.ndarray) -> DataFrame:
    """item, doc_id, score: documents whose exact score is above 0 and at least the item's threshold."""
    n_terms, n_items = len(block.vocabulary), len(block.names)

    def by_term(term: np.ndarray, item: np.ndarray):
        return np.searchsorted(term, np.arange(n_terms + 1)), item  # pairs come sorted by term

    shipped = ship(index.sparkSession, (by_term(block.term[kept], block.item[kept]), by_term(block.term, block.item), rest, threshold))

    def joined(where, items, flat, cell, impact):
        """Impacts by (row, item): each posting meets the items of its term."""
        n = where[flat + 1] - where[flat]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(where[flat], n)
        return np.repeat(cell, n) + items[at], np.repeat(impact, n)

    def run(batches):
        some, every, rest, threshold = shipped()
        rows = max(1, CELLS // n_items)
        for whole in batches:
            for i in range(0, whole.num_rows, rows):
                b = whole.slice(i, rows)
                flat, where, row = flattened(b, "terms")
                impact = b.column("impacts").flatten().to_numpy(zero_copy_only=False)
                cell, value = joined(*some, flat, row * n_items, impact)
                sums = np.bincount(cell, value, b.num_rows * n_items)  # a bound only: doubles do
                near = np.flatnonzero(sums)
                near = near[sums[near] + rest[near % n_items] >= threshold[near % n_items] * (1 - 1e-9)]
                # exact scores over all terms, of the rows that have a candidate
                used = np.zeros(b.num_rows, bool)
                used[near // n_items] = True
                own = used[row]
                cell, value = joined(*every, flat[own], row[own] * n_items, impact[own])
                slot = np.minimum(np.searchsorted(near, cell), max(len(near) - 1, 0))
                hit = near[slot] == cell if len(near) else np.zeros(0, bool)
                score = np.zeros(len(near), np.int64)
                np.add.at(score, slot[hit], value[hit])
                item = near % n_items
                kept = score >= np.maximum(threshold[item], 1)
                yield pa.RecordBatch.from_arrays([pa.array(item[kept], pa.int32()), b.column("doc_id").take(pa.array(near[kept] // n_items)), pa.array(score[kept])], names=["item", "doc_id", "score"])

    bounded_batches(index.sparkSession)
    return index.select("doc_id", "terms", "impacts").mapInArrow(run, FOUND)


# --- search ------------------------------------------------------------------------


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k highest-scoring documents with a score above 0, equal scores by ascending doc_id, null ids last.

    Null and empty texts hold no term: such a document is never found, such an
    item has no rows.  Rows of docs are documents of their own, rows of one
    item_id (null too) one item.  Empty tables give no rows; other columns don't count.
    """
    spark = docs.sparkSession
    asked = Staged(item_terms(items), "item-terms").df
    blocks = [r["block"] for r in asked.select("block").distinct().orderBy("block").toLocalIterator()]
    found = None
    for number in blocks:
        block = Block(asked.filter(F.col("block") == number).collect())  # bounded by BLOCK_TERMS, or one item
        some = search_block(docs, block, k)
        name = spark.createDataFrame([(i, x) for i, x in enumerate(block.names)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        named = some.join(F.broadcast(name), "item").select("item_id", "rank", "doc_id", "score")
        found = named if found is None else found.unionByName(named)
    if found is None:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    return found


def search_block(docs: DataFrame, block: Block, k: int) -> DataFrame:
    """item, rank, doc_id, score of the items of a block."""
    spark, n_terms, n_items = docs.sparkSession, len(block.vocabulary), len(block.names)
    counts = Staged(term_counts(docs, block.vocabulary), "term-counts").df
    size = counts.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = np.zeros(n_terms, np.int64)
    for r in counts.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # a row a term of the block
        df[r["term"]] = r["count"]
    weights = np.floor(1000 * np.log((2.0 * size["docs"] + 2) / (2.0 * df + 1))).astype(np.int64)
    index = Staged(impact_index(counts, weights, size["docs"], max(size["terms"], 1)), "impacts").df
    top = Staged(greatest(index, k), "greatest").df
    highest, kth = np.zeros(n_terms, np.int64), np.zeros(n_terms, np.int64)
    for r in top.filter((F.col("place") == 1) | (F.col("place") == k)).toLocalIterator():  # two rows a term of the block
        if r["place"] == 1:
            highest[r["term"]] = r["impact"]
        if r["place"] == k:
            kth[r["term"]] = r["impact"]
    threshold = np.zeros(n_items, np.int64)
    np.maximum.at(threshold, block.item, kth[block.term])
    pairs = spark.createDataFrame(list(zip(block.item.tolist(), block.term.tolist(), strict=True)), "item long, term long")
    for r in seeds(index, top, pairs, k).toLocalIterator():  # a row an item of the block
        threshold[r["item"]] = max(threshold[r["item"]], r["score"])
    kept, rest = essential(block, highest, threshold)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return candidates(index, block, kept, rest, threshold).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
size AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
p AS (SELECT r, doc_id, len AS n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS len, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * (SELECT n FROM size) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p GROUP BY term),
i AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + ((90 * p.n * size.n) // size.l)))) AS impact FROM p JOIN w USING (term), size),
s AS (SELECT item_id, r, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
