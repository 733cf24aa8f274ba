"""Best-fit decreasing packing of documents into sequences (operator 13).

A document is its token ids and an end id; a longer one than a sequence is cut
into pieces.  Lengths of pieces are whole numbers up to the capacity, so a
histogram of lengths (one count a length, whatever the corpus holds) is all
that best fit needs to see: pieces are placed by descending length, each in the
tightest open bin, which a segment tree over remaining capacities finds in
logarithmic time.  Pieces of one length and bins of one remaining capacity are
placed as one run, so the plan is that of the whole corpus, never of a shard,
and no larger for a larger one.  Tokenising, numbering the pieces of a length and
looking their places up in the plan are Spark jobs over all rows.

Tokens are found a white-space word at a time and remembered: the tokenizer's
normalisation and its pattern don't look across ASCII white space, so the ids of
a text are those of its words (a test holds them against whole texts).  This
holds for the tokenizer of the query, whose pattern is ``PARTS`` in ASCII.
"""

from __future__ import annotations

import re
import zlib
from bisect import insort
from itertools import compress, takewhile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Staged, bounded_batches, prefix_sums, ship, slices, small_or_plain

CAPACITY = 2048
END = 0
#: Parts of words of which a task remembers the ids; beyond it the memory starts anew.
REMEMBERED = 500_000
#: Words that are cut before the tokenizer sees them: printable ASCII, and letters that neither compose nor decompose (U+0130 would).
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
#: What the tokenizer's pattern makes of these in lower case; a line end comes between words.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u024f]+|[0-9]|\n|[^\na-z0-9\u00c0-\u024f]+")


# --- tokens --------------------------------------------------------------------


class WordTokenizer:
    """Ids of texts by a tokenizer whose words end at ASCII white space at the latest.

    Words of Latin letters and ASCII are cut further, where the tokenizer's
    pattern cuts them, so that it sees each run of letters once.  Such a part is
    one word to it, and its last id alone ends a word: that tells the ids of
    parts apart which go in one call.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.number = {"\n": 0}  # it stands between words and has no ids
        self.starts, self.ids, self.n_ids = [np.zeros(2, np.int64)], [np.zeros(0, np.uint32)], 0

    def add(self, parts: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.number.update(zip(parts, range(len(self.number), len(self.number) + len(parts)), strict=True))
        self.starts.append(self.n_ids + np.cumsum(lengths))  # where the next one begins
        self.ids.append(ids.astype(np.uint32))
        self.n_ids += len(ids)

    def learn(self, parts: list[str], odd: list[str]) -> None:
        """Ids of parts and of whole words that are new."""
        for i in range(0, len(parts), 1000):
            some = parts[i : i + 1000]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, np.int64)
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(some):
                self.add(some, ids, np.diff(last, prepend=-1))
            else:  # none of PLAIN; whatever it is, one by one is right
                odd = odd + some
        for i in range(0, len(odd), 1000):
            found = [e.ids for e in self.tokenizer.encode_batch(odd[i : i + 1000], add_special_tokens=False)]
            self.add(odd[i : i + 1000], np.array([x for own in found for x in own], np.int64), np.array([len(own) for own in found], np.int64))

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the words' parts in the table of ids, one word after the other, and how many each word has."""
        if len(self.number) > REMEMBERED or self.n_ids > 8 * REMEMBERED:
            self.forget()
        plain = ["<|" not in w and PLAIN.fullmatch(w) is not None for w in words]  # special tokens are whole words' business
        cut = iter(PARTS.findall("\n".join(compress(words, plain)).lower()))
        parts = [p for w, easy in zip(words, plain, strict=True) for p in ((*takewhile("\n".__ne__, cut), "\n") if easy else (w, "\n"))] if not all(plain) else [*cut, "\n"]
        new = dict.fromkeys(parts).keys() - self.number.keys()
        odd = {w for w, easy in zip(words, plain, strict=True) if not easy} & new
        self.learn(sorted(new - odd), sorted(odd))
        found = np.fromiter(map(self.number.__getitem__, parts), np.int64, len(parts))
        ends = np.flatnonzero(found == 0)
        return found[found > 0], np.diff(ends, prepend=-1) - 1

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each begins (and the last ends); null is empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        flat = split.flatten().dictionary_encode()
        part, n_parts = self.rows(flat.dictionary.to_pylist()) if len(flat) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.starts, self.ids = [np.concatenate(self.starts)], [np.concatenate(self.ids)]
        starts, table = self.starts[0], self.ids[0]
        # words of this batch as runs of ids, then texts as runs of words
        own, _ = ranges(starts[part], starts[part + 1] - starts[part])
        sizes = np.concatenate([[0], np.cumsum(starts[part + 1] - starts[part])])[np.concatenate([[0], np.cumsum(n_parts)])]
        which = flat.indices.to_numpy(zero_copy_only=False)
        at, ends = ranges(sizes[which], sizes[which + 1] - sizes[which])
        offsets = split.offsets.to_numpy()
        return table[own][at], np.concatenate([[0], ends])[offsets - offsets[0]]


def ranges(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """start, start + 1, ... of each range one after the other, and where each ends."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + length, length), ends


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece (and its ids), and part and nth: the task that made it and its number there among those of its length.

    ``tokenizer``: path of the tokenizer's file, read by the driver.  The result
    has to be staged before it is used twice: part and nth are of one run.
    """
    with open(tokenizer, encoding="utf-8") as f:
        model = ship(docs.sparkSession, f.read())
    bounded_batches(docs.sparkSession)
    fields = "doc_id " + docs.schema["doc_id"].dataType.simpleString() + ", piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<long>" * with_ids

    def run(batches):
        from pyspark import TaskContext

        part, words = TaskContext.get().partitionId(), WordTokenizer(model())
        made = np.zeros(capacity + 1, np.int64)
        for b in slices(batches):
            ids, begins = words.encode(b.column("text"))
            out = {k: [] for k in ("row", "piece", "start", "length", "crc", "nth", "ids")}
            for row in range(b.num_rows):
                own = np.append(ids[begins[row] : begins[row + 1]], np.uint32(end)).astype("<u4")
                for piece, start in enumerate(range(0, len(own), capacity)):
                    cut = own[start : start + capacity]
                    n = len(cut)
                    for k, v in (("row", row), ("piece", piece), ("start", start), ("length", n), ("crc", zlib.crc32(cut.tobytes())), ("nth", made[n])):
                        out[k].append(v)
                    if with_ids:
                        out["ids"].append(cut.astype(np.int64))
                    made[n] += 1
            long = lambda k: pa.array(out[k], pa.int64())
            columns = [b.column("doc_id").take(long("row")), long("piece").cast(pa.int32()), long("start"), long("length"), long("crc"), pa.array([part] * len(out["row"]), pa.int32()), long("nth")]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            if with_ids:
                columns, names = [*columns, pa.array(out["ids"], pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, fields)


# --- the plan ------------------------------------------------------------------


class OpenBins:
    """A segment tree over remaining capacities; a leaf holds the runs of bins that have so much left."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def put(self, left: int, first: int, n: int) -> None:
        """n bins from number ``first`` on have ``left`` left."""
        insort(self.runs[left], (first, n))
        self._add(left, 1)

    def take(self, left: int) -> tuple[int, int]:
        self._add(left, -1)
        return self.runs[left].pop(0)

    def _add(self, left: int, by: int) -> None:
        node = left + self.size
        while node:
            self.count[node] += by
            node //= 2

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least ``length`` that an open bin has."""
        node = length + self.size
        if self.count[node]:
            return length
        while node > 1:  # up until there is something to the right, then down to its leftmost leaf
            if node % 2 == 0 and self.count[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.size
            node //= 2
        return None


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing of a histogram of lengths: runs (length, first, per_bin, sequence, offset) and the number of bins.

    Pieces of that length with numbers from ``first`` on, until the next run of
    it, go ``per_bin`` to a bin, from bin ``sequence`` and place ``offset`` on.
    A bin that takes one piece and has room for another is the tightest then,
    so a run fills one bin after the other, as piece by piece would.
    """
    bins, opened, plan = OpenBins(capacity), 0, []
    for length in sorted(histogram, reverse=True):
        done, n = 0, histogram[length]
        while done < n:
            left = bins.tightest(length)
            if left is None:
                left, fresh = capacity, -(-(n - done) // (capacity // length))
                bins.put(capacity, opened, fresh)
                opened += fresh
            first, m = bins.take(left)
            each = left // length
            full = min(m, (n - done) // each)
            if full:
                plan.append((length, done, each, first, capacity - left))
                bins.put(left - each * length, first, full)
                done, first, m = done + full * each, first + full, m - full
            if m and done < n:
                if n - done < each:  # the last ones, in one bin
                    plan.append((length, done, each, first, capacity - left))
                    bins.put(left - (n - done) * length, first, 1)
                    done, first, m = n, first + 1, m - 1
            if m:
                bins.put(left, first, m)
    return plan, opened


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece of every document.

    Only documents of more than ``capacity`` tokens are cut.  Null and empty
    texts are the end id alone; rows are documents of their own, repeated ones
    and null ids too; a table without rows gives none; other columns don't count.
    Sequences are numbered from 0 and filled from 0 without gaps.
    """
    made = Staged(pieces(docs, tokenizer, capacity, end, with_ids), "pieces").df
    counts = Staged(made.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts").df
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length, capacity at most
    plan, _ = best_fit(histogram, capacity)
    plan.sort()
    # runs of a length in order of their first piece; a length's numbers stay under 2**40
    table = ship(docs.sparkSession, (np.array([(p[0] << 40) + p[1] for p in plan], np.int64), np.array([p[1:] for p in plan], np.int64).reshape(-1, 4)))
    base = prefix_sums(counts, ["length"], "part", "n", "base").select(F.col("part").alias("b_part"), F.col("length").alias("b_length"), "base")
    n_base = counts.count()
    numbered = made.join(small_or_plain(base, n_base, 32), (F.col("part") == F.col("b_part")) & (F.col("length") == F.col("b_length"))).drop("b_part", "b_length")
    places = [T.StructField(name, T.LongType()) for name in ("sequence_id", "offset")]
    schema = T.StructType([f for f in made.schema if f.name not in ("part", "nth", "ids")] + places + [f for f in made.schema if f.name == "ids"])

    def run(batches):
        keys, rest = table()
        for b in batches:
            length = b.column("length").to_numpy()
            number = b.column("base").to_numpy() + b.column("nth").to_numpy()
            row = np.searchsorted(keys, (length << 40) + number, "right") - 1
            first, each, sequence, offset = rest[row].T
            at = number - first
            found = {"sequence_id": pa.array(sequence + at // each), "offset": pa.array(offset + at % each * length)}
            yield pa.RecordBatch.from_arrays([found[f.name] if f.name in found else b.column(f.name) for f in schema], names=schema.names)

    return numbered.select(*[f.name for f in schema if f.name in numbered.columns], "nth", "base").mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids of each sequence of a pack() with ids, by offset; a sequence holds ``capacity`` ids at most."""
    gathered = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return gathered.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.doc_id").alias("doc_ids"))
