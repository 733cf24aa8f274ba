"""Brown class-based n-gram scoring (operator 3).

P(text) is a product over tokens of P(class | class before) * P(word | class).
Exchange clustering gives words their classes: in a round words move to the
class where the likelihood of all class bigrams gains most; a round that loses
likelihood is taken back and tried with fewer of its moves, and rounds end when
they gain next to nothing.

Words fall in two parts.  A *head* word makes up at least HEAD_SHARE of all
training tokens, so there are at most 1 / HEAD_SHARE of them whatever the size
of the corpus: their classes may stand on every machine.  The open-ended *tail*
is never gathered.  While the head is clustered, tail words of one ending move
between classes together, by the contexts of all of them.  Then every tail word
gets a class of its own from its own contexts.

Texts are split into words twice: to count them, and to number them.  Numbered
texts are one table, a row a slice of texts; a slice numbers its tail words
itself, each once, and deals them to buckets by a hash.  What all slices know
of a bucket's words meets in one group, which settles counts and classes; they
go back to the slices, bucket by bucket.  The counts of class bigrams are then
made anew from the texts.  Bigrams of symbols are dealt by symbol, once, so
that a round adds up a symbol's contexts where they lie.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Staged, ascii_lower, bounded_batches, remainder, ship, slices, words_of

END = " "  # no word holds a space
HEAD_SHARE = 1e-5
CLASSES = 64
#: Groups of tail words, and letters of the ending that says which.
TAILS, ENDING = 2048, 3
#: Two rounds in a row that gain no larger share of the likelihood end the exchange; no more rounds than these are made.
TOLERANCE, ROUNDS = 2e-3, 10
#: Share of the symbols that a round moves at first, and the least it tries after losses.
SHARE, LEAST_SHARE = 0.5, 0.1
#: Pseudo-count with which class bigrams lean on class unigrams.
LEAN = 50.0
#: Symbols that move one after the other in one block.
BLOCK = 2048
#: Bytes of text that one worker turns into words at once, and words that it counts before it passes the counts on.
SLICE_CHARS, COUNTED = 2 << 20, 200_000
#: Tokens of the corpus to a bucket of tail words, that are settled at once, and buckets at least; contexts of words that are added up at once.
SETTLED, BUCKETS, ADDED = 1 << 21, 64, 1 << 16
#: Bigrams that a task adds up at once.
PAIRS = 1 << 20
#: Held-out words of fewer places are never frequent.
FREQUENT = 1000

KINDS = CLASSES + 1  # clusters, the end
PAIR = T.StructType([T.StructField("pair", T.LongType()), T.StructField("n", T.LongType())])
PAIR_ARROW = pa.schema([("pair", pa.int64()), ("n", pa.int64())])


def in_training(doc_id: Column) -> Column:
    """The crc32 remainder isn't 1; a null id teaches nothing."""
    return F.coalesce(remainder(doc_id, 5) != 1, F.lit(False))


def tail_group(ending: str) -> int:
    return zlib.crc32(ending.encode()) % TAILS


class Numbers(dict):
    """Numbers of words; a word that has none gets the next one."""

    def __init__(self, known: dict[str, int], first: int):
        super().__init__(known)
        self.first, self.new = first, []

    def __missing__(self, word: str) -> int:
        n = self[word] = self.first + len(self.new)
        self.new.append(word)
        return n


class Lexicon:
    """Numbers of symbols: head words from 0, the end, groups of tail words, then words apart (tail words that are read by themselves).

    A slice of texts numbers its other tail words from ``known`` on.
    """

    def __init__(self, words: list[str], apart: list[str] | None = None):
        self.words, self.apart = words, apart or []
        self.end = len(words)
        self.size = len(words) + 1 + TAILS
        self.known = self.size + len(self.apart)

    def prepare(self) -> None:
        if not hasattr(self, "number"):
            self.number = {w: i for i, w in enumerate(self.words)} | {END: self.end} | {w: self.size + i for i, w in enumerate(self.apart)}
            self.suffix: dict[str, int] = {}

    def __getstate__(self):
        return {"words": self.words, "apart": self.apart, "end": self.end, "size": self.size, "known": self.known}

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Numbers of all tokens, each text with its end; tokens a text; the tail words, in the order of their numbers."""
        self.prepare()
        numbers, tokens, edges = Numbers(self.number, self.known), [], [0]
        for t in texts:
            if t:
                tokens += words_of(ascii_lower(t))
            tokens.append(END)
            edges.append(len(tokens))
        return np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens)), np.diff(edges).astype(np.int32), numbers.new

    def groups(self, words: list[str]) -> np.ndarray:
        """Group of each tail word."""
        self.prepare()
        suffix, endings = self.suffix, [w[-ENDING:] for w in words]
        for x in set(endings) - suffix.keys():
            suffix[x] = tail_group(x)
        return np.array([suffix[x] for x in endings], np.uint16)

    def symbols(self) -> np.ndarray:
        """The symbol of each known number: a word apart is one of its ending's group."""
        return np.concatenate([np.arange(self.size), self.end + 1 + self.groups(self.apart).astype(np.int64)])

    def start_classes(self) -> np.ndarray:
        """Class of each symbol before clustering: head words by frequency in turn, tail groups in turn; the end has its own."""
        return np.concatenate([np.arange(self.end) % CLASSES, [CLASSES], np.arange(TAILS) % CLASSES])


# --- counting -------------------------------------------------------------------


def word_counts(docs: DataFrame) -> Staged:
    """word, n of all training tokens, ends included."""
    return Staged(counted(docs.filter(in_training(F.col("doc_id")))), "words")


def counted(docs: DataFrame) -> DataFrame:
    """word, n of all tokens, ends included; counted on the way in batches of texts, so that few rows shuffle."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        count: Counter[str] = Counter()

        def full():
            out = pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])
            count.clear()
            return out

        for b in slices(batches, SLICE_CHARS):
            for t in b.column("text").to_pylist():
                if t:
                    count.update(words_of(ascii_lower(t)))
            count[END] += b.num_rows
            if len(count) > COUNTED:
                yield full()
        if count:
            yield full()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary array: the bytes of as many values as the sizes say."""
    edges = np.concatenate([[0], np.cumsum(sizes)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def whole(values: np.ndarray) -> pa.Array:
    return packed(values, np.array([len(values)]))


def values_of(b: pa.RecordBatch | pa.Table, column: str, i: int, kind) -> np.ndarray:
    """Values of a binary column's row."""
    return np.frombuffer(b.column(column)[i].as_py(), kind)


def joined(t: pa.RecordBatch | pa.Table, column: str, kind, order=None) -> np.ndarray:
    """Values of all rows of a binary column, one row after the other."""
    return np.concatenate([np.zeros(0, kind), *(values_of(t, column, i, kind) for i in (range(t.num_rows) if order is None else order))])


def flags(b: pa.RecordBatch | pa.Table, column: str, i: int) -> np.ndarray:
    return np.array(b.column(column)[i].as_py(), bool)


#: Multipliers of a word's bytes, by place.
MIX = np.random.default_rng(0).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def hashed(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """31 bits from the bytes of each word; no word is empty."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    start = np.cumsum(sizes) - sizes
    mixed = np.add.reduceat((data + np.uint64(1)) * MIX[(np.arange(len(data)) - np.repeat(start, sizes)) % len(MIX)], start)
    return ((mixed ^ (mixed >> np.uint64(29))) * MIX[0] >> np.uint64(33)).astype(np.int64)


def characters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array that has no offset, and their number in each word."""
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(0, np.int32)
    edges = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1]
    return np.frombuffer(words.buffers()[2], np.uint8)[: edges[-1]], np.diff(edges)


def bucket_count(tokens: int) -> int:
    """Buckets of tail words: in proportion to the corpus, so that none grows with it."""
    return max(BUCKETS, -(-tokens // SETTLED))


def encoded(docs: DataFrame, lexicon: Lexicon, buckets: int) -> DataFrame:
    """Texts as numbers, a row a slice: ids of a text's tokens; its tail words' bytes, lengths and groups by bucket, and how many each bucket has."""
    bounded_batches(docs.sparkSession)
    shared = ship(docs.sparkSession, lexicon)
    binary = [T.StructField(c, T.BinaryType()) for c in ("sizes", "ids", "words", "lengths", "groups", "dealt")]
    schema = T.StructType([T.StructField("doc_id", T.ArrayType(docs.schema["doc_id"].dataType)), T.StructField("taught", T.ArrayType(T.BooleanType())), *binary])
    arrow = to_arrow_schema(schema, prefers_large_types=False)

    def run(batches):
        lex = shared()
        for b in slices(batches, SLICE_CHARS):
            ids, sizes, new = lex.encode(b.column("text").to_pylist())
            words, groups = pa.array(new, pa.string()), lex.groups(new)
            bucket = hashed(*characters(words)) % buckets
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(lex.known, lex.known + len(order))
            rare = ids >= lex.known
            ids[rare] = place[ids[rare] - lex.known]
            data, lengths = characters(words.take(pa.array(order)))
            out = [whole(x) for x in (sizes, ids, data, lengths, groups[order], np.bincount(bucket, minlength=buckets).astype(np.int32))]
            rows = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(c), type=arrow.field(c).type) for c in ("doc_id", "taught")]
            yield pa.RecordBatch.from_arrays([*rows, *out], schema=arrow)

    texts = docs.select("doc_id", in_training(F.col("doc_id")).alias("taught"), "text").mapInArrow(run, schema)
    return texts.withColumn("slice", F.monotonically_increasing_id())


def bigram_counts(docs: DataFrame, lexicon: Lexicon) -> Staged:
    """pair (first symbol * size + second), n over all training texts."""
    return Staged(symbol_pairs(encoded(docs, lexicon, BUCKETS), lexicon, BUCKETS), "bigrams")


def symbol_kind(size: int):
    return np.uint16 if size <= 1 << 16 else np.int32


def symbol_pairs(texts: DataFrame, lexicon: Lexicon, parts: int) -> DataFrame:
    """pair, n of encoded texts that teach: counted where they are read, and added up by parts of all pairs."""
    shared, size, kind = ship(texts.sparkSession, lexicon), lexicon.size, symbol_kind(lexicon.size)

    def run(batches):
        lex = shared()
        known = lex.symbols()

        def counted(pairs):
            pair, n = np.unique(np.concatenate(pairs), return_counts=True)
            part = pair % parts
            order = np.argsort(part, kind="stable")
            pair, sizes = pair[order], np.bincount(part, minlength=parts)
            columns = [pa.array(np.arange(parts, dtype=np.int32)), packed((pair // size).astype(kind), sizes), packed((pair % size).astype(kind), sizes), packed(n[order].astype(np.int64), sizes)]
            return pa.RecordBatch.from_arrays(columns, names=["part", "first", "second", "n"]).filter(pa.array(sizes > 0))

        held, tokens = [], 0
        for b in batches:
            for i in range(b.num_rows):
                now = np.concatenate([known, lex.end + 1 + values_of(b, "groups", i, np.uint16).astype(np.int64)])[values_of(b, "ids", i, np.int32)]
                pair = np.concatenate([[lex.end], now[:-1]]) * size + now  # texts end with the end, which so stands before the next
                held.append(pair[np.repeat(flags(b, "taught", i), values_of(b, "sizes", i, np.int32))])
                tokens += len(held[-1])
                if tokens >= 4 * PAIRS:
                    yield counted(held)
                    held, tokens = [], 0
        if tokens:
            yield counted(held)

    def added(t: pa.Table) -> pa.Table:
        pair = joined(t, "first", kind).astype(np.int64) * size + joined(t, "second", kind)
        order = np.argsort(pair)
        pair = pair[order]
        start = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        return pa.table([pa.array(pair[start]), pa.array(np.add.reduceat(joined(t, "n", np.int64)[order], start))], schema=PAIR_ARROW)

    found = texts.select("taught", "sizes", "ids", "groups").mapInArrow(run, "part int, first binary, second binary, n binary")
    return found.groupBy("part").applyInArrow(added, PAIR)


def in_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """pair and n of many rows at once."""
    held, rows = [], 0
    for b in batches:
        held.append((b.column("pair").to_numpy(), b.column("n").to_numpy()))
        rows += b.num_rows
        if rows >= PAIRS:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, rows = [], 0
    if rows:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


DEALT = "part int, follows boolean, symbol binary, other binary, n binary"


def dealt_pairs(bigrams: DataFrame, size: int) -> Staged:
    """Each pair twice: with its first symbol, which the other follows, and with its second; all pairs of a symbol lie in one part."""
    kind = symbol_kind(size)

    def run(batches):
        for pair, n in in_batches(batches):
            for follows, symbol, other in ((True, pair // size, pair % size), (False, pair % size, pair // size)):
                part = symbol % BUCKETS
                order, sizes = np.lexsort((symbol, part)), np.bincount(part, minlength=BUCKETS)
                columns = [packed(x[order], sizes) for x in (symbol.astype(kind), other.astype(kind), n)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array([follows] * BUCKETS), *columns], names=["part", "follows", "symbol", "other", "n"]).filter(pa.array(sizes > 0))

    return Staged(bigrams.mapInArrow(run, DEALT).repartition("part"), "dealt")


def class_vectors(dealt: DataFrame, size: int, classes: np.ndarray, drawn: np.ndarray) -> DataFrame:
    """symbol, slot, n of the drawn symbols: how often each class follows (slot: class), precedes (KINDS + class) a symbol, and it itself (2 KINDS)."""
    shared, slots, small = ship(dealt.sparkSession, (classes, drawn)), 2 * KINDS + 1, symbol_kind(size)

    def run(batches):
        kind, drawn = shared()
        width = (size // BUCKETS + 1) * slots
        totals: dict[int, np.ndarray] = {}  # of a part's symbols, which are BUCKETS apart; all have at most (1 / HEAD_SHARE + TAILS) * slots numbers
        for b in batches:
            for i in range(b.num_rows):
                symbol, other, n = values_of(b, "symbol", i, small), values_of(b, "other", i, small), values_of(b, "n", i, np.int64)
                mine, follows = drawn[symbol], b.column("follows")[i].as_py()
                symbol, other, n = symbol[mine], other[mine], n[mine]
                row = symbol.astype(np.int64) // BUCKETS * slots
                key = row + (0 if follows else KINDS) + kind[other]
                if follows:
                    same = symbol == other
                    key, n = np.concatenate([key, row[same] + 2 * KINDS]), np.concatenate([n, n[same]])
                sums, part = np.bincount(key, n, width), b.column("part")[i].as_py()
                totals[part] = totals[part] + sums if part in totals else sums
        for part, total in totals.items():
            full = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array((full // slots * BUCKETS + part) * slots + full % slots), pa.array(total[full].astype(np.int64))], schema=PAIR_ARROW)

    keyed = dealt.mapInArrow(run, PAIR).groupBy("pair").agg(F.sum("n").alias("n"))
    return keyed.select(F.expr(f"pair div {slots}").cast("int").alias("symbol"), (F.col("pair") % slots).cast("int").alias("slot"), "n")


def class_matrix(dealt: DataFrame, size: int, classes: np.ndarray) -> np.ndarray:
    """Counts of class bigrams: KINDS x KINDS numbers, whatever the corpus."""
    shared, small = ship(dealt.sparkSession, classes), symbol_kind(size)

    def run(batches):
        total, kind = np.zeros(KINDS * KINDS), shared()
        for b in batches:
            for i in range(b.num_rows):
                key = kind[values_of(b, "symbol", i, small)] * KINDS + kind[values_of(b, "other", i, small)]
                total += np.bincount(key, values_of(b, "n", i, np.int64), KINDS * KINDS)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int64)), pa.array(total[full].astype(np.int64))], schema=PAIR_ARROW)

    m = np.zeros(KINDS * KINDS)
    for pair, n in dealt.filter("follows").select("symbol", "other", "n").mapInArrow(run, PAIR).groupBy("pair").agg(F.sum("n")).collect():
        m[pair] = n
    return m.reshape(KINDS, KINDS)


# --- exchange -------------------------------------------------------------------


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(m: np.ndarray) -> float:
    """Log likelihood of class bigrams, up to the words' own entropy."""
    return float(xlogx(m).sum() - xlogx(m.sum(axis=0)).sum() - xlogx(m.sum(axis=1)).sum())


def best_class(m: np.ndarray, now: int, after: np.ndarray, before: np.ndarray, itself: float) -> tuple[int, float]:
    """The class that a word gains most by moving to, and that gain over staying; m counts the word where it is."""
    less = m.copy()
    less[now] -= after
    less[:, now] -= before
    less[now, now] += itself
    np.maximum(less, 0, out=less)
    after, before = after.copy(), before.copy()
    after[now] -= itself
    before[now] -= itself
    at = np.arange(CLASSES)
    out, into, corner = less[:CLASSES], less[:, :CLASSES].T, less[at, at]
    gain = (xlogx(out + after) - xlogx(out)).sum(axis=1) + (xlogx(into + before) - xlogx(into)).sum(axis=1)
    gain -= xlogx(corner + after[:CLASSES]) - xlogx(corner) + xlogx(corner + before[:CLASSES]) - xlogx(corner)
    gain += xlogx(corner + after[:CLASSES] + before[:CLASSES] + itself) - xlogx(corner)
    # whichever class the word goes to, all classes' margins get back their bigrams with it
    rows, columns = (less.sum(axis=1) + before)[:CLASSES], (less.sum(axis=0) + after)[:CLASSES]
    for margin, more in ((rows, after.sum() + itself), (columns, before.sum() + itself)):
        gain -= xlogx(margin + more) - xlogx(margin)
    best = int(gain.argmax())
    return best, float(gain[best] - gain[now])


def taken_along(m: np.ndarray, now: int, to: int, after: np.ndarray, before: np.ndarray, itself: float) -> None:
    """Move a word's bigrams in m from its class to another; a neighbour that moved earlier may have taken some, so none falls below zero."""
    after, before = after.copy(), before.copy()
    m[now] -= after
    m[:, now] -= before
    m[now, now] += itself
    after[now] -= itself
    before[now] -= itself
    m[to] += after
    m[:, to] += before
    m[to, to] += itself
    np.maximum(m, 0, out=m)


MOVES = T.StructType([T.StructField("symbol", T.IntegerType()), T.StructField("best", T.IntegerType())])


def moves(dealt: DataFrame, m: np.ndarray, lexicon: Lexicon, classes: np.ndarray, drawn: np.ndarray) -> list:
    """Moves of the drawn head words and tail groups, at most 1 / HEAD_SHARE + TAILS rows.

    A block of symbols makes its moves one after the other on its own copy of m;
    only those of other blocks it can't see.
    """
    shared = ship(dealt.sparkSession, (m, classes))

    def of(block: pd.DataFrame) -> pd.DataFrame:
        m, classes = shared()
        m, out = m.copy(), []
        for symbol, own in block.groupby("symbol"):
            v = np.zeros(2 * KINDS + 1)
            v[own["slot"].to_numpy()] = own["n"].to_numpy()
            after, before, itself, now = v[:KINDS], v[KINDS : 2 * KINDS], v[2 * KINDS], int(classes[symbol])
            best, gain = best_class(m, now, after, before, itself)
            if gain > 1e-6:
                out.append((symbol, best))
                taken_along(m, now, best, after, before, itself)
        return pd.DataFrame(out, columns=["symbol", "best"])

    block = F.pmod(F.hash("symbol"), F.lit(-(-lexicon.size // BLOCK)))
    return class_vectors(dealt, lexicon.size, classes, drawn).groupBy(block).applyInPandas(of, MOVES).collect()


def cluster(bigrams: DataFrame, lexicon: Lexicon, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Class of each symbol, counts of class bigrams, and the likelihood of each round kept.

    A round moves a share of the symbols, drawn anew each time, as blocks can't
    see each other's moves.  One that loses is taken back and halves the share;
    too small a share, or two rounds in a row that gain less than the tolerance,
    end the exchange.
    """
    classes, share, quiet = lexicon.start_classes(), SHARE, 0
    dealt = dealt_pairs(bigrams, lexicon.size)
    m = class_matrix(dealt.df, lexicon.size, classes)
    history = [likelihood(m)]
    for turn in range(rounds):
        drawn = np.random.default_rng(turn).random(lexicon.size) < share
        drawn[lexicon.end] = False
        trial = classes.copy()
        for symbol, to in moves(dealt.df, m, lexicon, classes, drawn):
            trial[symbol] = to
        trial_m = class_matrix(dealt.df, lexicon.size, trial)
        gain = likelihood(trial_m) - history[-1]
        if gain < 0:
            share /= 2
        else:
            quiet = quiet + 1 if gain < tolerance * abs(history[-1]) else 0
            classes, m = trial, trial_m
            history += [history[-1] + gain] if gain else []
        if quiet == 2 or share < LEAST_SHARE:
            break
    dealt.drop()
    return classes, m, history


# --- classes of tail words ----------------------------------------------------------


def likely(m: np.ndarray) -> np.ndarray:
    """What a context (class before * KINDS + class after) adds to the likelihood with a word of few tokens in each class.

    The gain of exchange to the first order.  Whole numbers, so that sums are the same in any order.
    """
    out, into = np.log(m.sum(axis=1)[:CLASSES] + 0.5 * KINDS), np.log(m.sum(axis=0)[:CLASSES] + 0.5 * KINDS)
    before, after = np.log(m[:, :CLASSES] + 0.5), np.log(m[:CLASSES].T + 0.5)
    return np.rint((before[:, None] + after[None] - out - into) * (1 << 20)).astype(np.int64).reshape(KINDS * KINDS, CLASSES)


def likeliest(contexts: np.ndarray, n: np.ndarray, gains: np.ndarray) -> np.ndarray:
    """The class of each word in which its n contexts (one at least), which lie one word after the other, are likeliest."""
    edge, kind, i = np.concatenate([[0], np.cumsum(n)]), np.empty(len(n), np.int64), 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(edge, edge[i] + ADDED, "right")) - 1)
        own = contexts[edge[i] : edge[j]]
        if j == i + 1:
            kind[i] = (np.bincount(own, minlength=len(gains)) @ gains).argmax()
        else:
            kind[i:j] = np.add.reduceat(gains[own], edge[i:j] - edge[i], axis=0).argmax(axis=1)
        i = j
    return kind


class Model:
    """Counts and classes of head words and groups, and what contexts say of a tail word's class."""

    def __init__(self, lexicon: Lexicon, counts: np.ndarray, classes: np.ndarray, m: np.ndarray, apart: np.ndarray, total: int, distinct: int):
        """counts: of head words and the end; apart: of the words apart."""
        self.lexicon, self.total = lexicon, total
        self.classes = classes[lexicon.symbols()].astype(np.int64)
        n = np.concatenate([counts, np.zeros(TAILS), apart])
        self.logs, self.known = np.log10(n + 0.5), n > 0
        self.words = np.bincount(self.classes[self.known], minlength=KINDS)
        self.gains = likely(m)
        self.base = -math.log10(total + 0.5 * (distinct + 1))

    def group_classes(self, groups: np.ndarray) -> np.ndarray:
        return self.classes[self.lexicon.end + 1 + groups.astype(np.int64)]


def tail_words(texts: DataFrame, shared) -> DataFrame:
    """A row a slice and bucket: bytes, lengths and groups of its tail words, how many contexts each has in texts that teach, and those."""

    def run(batches):
        model = shared()
        known = model.lexicon.known
        for b in batches:
            for i in range(b.num_rows):
                ids, groups, lengths, dealt = (values_of(b, c, i, k) for c, k in (("ids", np.int32), ("groups", np.uint16), ("lengths", np.int32), ("dealt", np.int32)))
                kind = np.concatenate([[CLASSES], np.concatenate([model.classes, model.group_classes(groups)])[ids]])
                at = np.flatnonzero((ids >= known) & np.repeat(flags(b, "taught", i), values_of(b, "sizes", i, np.int32)))  # none ends a text
                context, word = (kind[at] * KINDS + kind[at + 2]).astype(np.uint16), ids[at] - known
                n = np.bincount(word, minlength=len(groups)).astype(np.int32)
                edge = np.concatenate([[0], np.cumsum(dealt)])
                within = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[edge])  # noqa: B023, E731
                columns = [packed(values_of(b, "words", i, np.uint8), within(lengths)), *(packed(x, dealt) for x in (lengths, groups, n)), packed(context[np.argsort(word, kind="stable")], within(n))]
                where = [pa.array(np.full(len(dealt), b.column("slice")[i].as_py(), np.int64)), pa.array(np.arange(len(dealt), dtype=np.int32))]
                yield pa.RecordBatch.from_arrays([*where, *columns], names=["slice", "bucket", "words", "lengths", "groups", "n", "contexts"]).filter(pa.array(dealt > 0))

    return texts.select("slice", "taught", "sizes", "ids", "words", "lengths", "groups", "dealt").mapInArrow(run, "slice long, bucket int, words binary, lengths binary, groups binary, n binary, contexts binary")


def settled_words(texts: DataFrame, shared) -> DataFrame:
    """slice, bucket, n and kind (class * 2 + first) of its tail words; first marks one place of a word that was learned.

    All that is known of a bucket's words is one group, and buckets are as many as the corpus asks for.
    A word that training hasn't gets the class of its ending's group.
    """

    def settle(t: pa.Table) -> pa.Table:
        model = shared()
        lengths, n = joined(t, "lengths", np.int32), joined(t, "n", np.int32)
        edges = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(joined(t, "words", np.uint8).tobytes())])
        own = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.bincount(own, n).astype(np.int64)
        kind, learned = np.empty(len(total), np.int64), total > 0
        kind[own] = model.group_classes(joined(t, "groups", np.uint16))
        contexts = joined(t, "contexts", np.uint16)[np.argsort(np.repeat(own, n), kind="stable")]
        if learned.any():
            kind[learned] = likeliest(contexts, total[learned], model.gains)
        first = np.zeros(len(own), bool)
        first[np.unique(own, return_index=True)[1]] = True
        sizes = np.array([len(x.as_py()) // 4 for x in t.column("lengths")])
        answer = [packed(total[own].astype(np.uint32), sizes), packed((kind[own] * 2 + (first & learned[own])).astype(np.uint8), sizes)]
        return pa.table([t.column("slice"), t.column("bucket"), *answer], names=["slice", "bucket", "n", "kind"])

    return tail_words(texts, shared).groupBy("bucket").applyInArrow(settle, "slice long, bucket int, n binary, kind binary")


def settled(texts: DataFrame, met: DataFrame, shared) -> DataFrame:
    """The texts with the classes of all tokens, a row a slice; new: words of each class that are counted as distinct here."""
    schema = T.StructType([*(f for f in texts.schema.fields if f.name in ("doc_id", "taught", "sizes")), *(T.StructField(c, T.BinaryType()) for c in ("kinds", "n_known", "log", "new"))])
    arrow = to_arrow_schema(schema, prefers_large_types=False)

    def meet(t: pa.Table, met: pa.Table) -> pa.Table:
        model = shared()
        ids, sizes = values_of(t, "ids", 0, np.int32), values_of(t, "sizes", 0, np.int32)
        order = np.argsort(met.column("bucket").to_numpy())
        n, kind = joined(met, "n", np.uint32, order), joined(met, "kind", np.uint8, order)
        start = np.cumsum(sizes) - sizes
        add = lambda known, tail: np.add.reduceat(np.concatenate([known, tail])[ids], start)
        kinds = np.concatenate([model.classes.astype(np.uint8), kind // 2])[ids]
        new = np.bincount(kind[kind % 2 == 1] // 2, minlength=KINDS).astype(np.int64)
        found = kinds, add(model.known.astype(np.int64), (n > 0).astype(np.int64)), add(model.logs, np.log10(n + 0.5)), new
        return pa.table([t.column("doc_id"), t.column("taught"), t.column("sizes"), *map(whole, found)], schema=arrow)

    read = texts.select("slice", "doc_id", "taught", "sizes", "ids")
    return read.groupBy("slice").cogroup(met.groupBy("slice")).applyInArrow(meet, schema)


def settled_counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of class bigrams in the texts that teach, and distinct tail words of each class, marked in whichever texts."""

    def run(batches):
        total = np.zeros(KINDS * KINDS + KINDS, np.int64)
        for b in batches:
            for i in range(b.num_rows):
                kinds = values_of(b, "kinds", i, np.uint8).astype(np.int64)
                pair = np.concatenate([[CLASSES], kinds[:-1]]) * KINDS + kinds  # texts end with the end's class, so it also stands before the next
                total += np.bincount(pair[np.repeat(flags(b, "taught", i), values_of(b, "sizes", i, np.int32))], minlength=len(total))
                total[KINDS * KINDS :] += values_of(b, "new", i, np.int64)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], schema=PAIR_ARROW)

    out = np.zeros(KINDS * KINDS + KINDS)
    for pair, n in texts.select("taught", "sizes", "kinds", "new").mapInArrow(run, PAIR).groupBy("pair").agg(F.sum("n")).collect():
        out[pair] = n
    return out[: KINDS * KINDS].reshape(KINDS, KINDS), out[KINDS * KINDS :]


# --- the model ------------------------------------------------------------------


def transitions(m: np.ndarray) -> np.ndarray:
    """Logarithms (base 10) of class after class, smoothed towards the class alone."""
    unigram = (m.sum(axis=0) + 0.5) / (m.sum() + 0.5 * KINDS)
    return np.log10((m + LEAN * unigram) / (m.sum(axis=1, keepdims=True) + LEAN))


def rooms(m: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Logarithm of each class's tokens, with half a token for each of its words and for one that no one has seen."""
    return np.log10(m.sum(axis=0) + 0.5 * (words + 1))


def train(docs: DataFrame) -> Model:
    """Model of the training rows."""
    model, texts = learned(docs)
    texts.drop()
    return model


def learned(docs: DataFrame) -> tuple[Model, Staged]:
    """Model of the training rows, and all texts as its lexicon's numbers."""
    counts = word_counts(docs)
    total, distinct = counts.df.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    cut = max(2, math.ceil(HEAD_SHARE * total))
    # at most 1 / HEAD_SHARE words: their counts add up to total at most
    head = sorted(counts.df.filter((F.col("n") >= cut) & (F.col("word") != END)).collect(), key=lambda r: (-r["n"], r["word"]))
    ends = counts.df.filter(F.col("word") == END).first()
    apart, others = frequent_apart(docs, counts.df, cut)
    counts.drop()
    lexicon, buckets = Lexicon([r["word"] for r in head], list(apart)), bucket_count(int(total + others))
    texts = Staged(encoded(docs, lexicon, buckets), "texts")
    bigrams = Staged(symbol_pairs(texts.df, lexicon, buckets), "bigrams")
    classes, m, _ = cluster(bigrams.df, lexicon)
    bigrams.drop()
    known = np.array([r["n"] for r in head] + [ends["n"] if ends else 0], np.float64)
    return Model(lexicon, known, classes, m, np.array(list(apart.values()), np.float64), int(total), int(distinct)), texts


def frequent_apart(docs: DataFrame, counts: DataFrame, cut: int) -> tuple[dict[str, int], int]:
    """Training counts of tail words that held-out texts are full of, so that no task gets all their places; at most 1 / HEAD_SHARE words.  And tokens of those texts."""
    held = Staged(counted(docs.filter(~in_training(F.col("doc_id")))), "held")
    tokens = held.df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    floor = max(FREQUENT, cut, math.ceil(HEAD_SHARE * tokens))
    many = held.df.filter((F.col("n") >= floor) & (F.col("word") != END)).select("word")
    rows = many.join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n")).filter(F.col("n") < cut).collect()
    held.drop()
    return {r["word"]: r["n"] for r in sorted(rows)}, tokens


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity: a row a document.

    Learned from the rows whose crc32 remainder isn't 1.  Null texts are empty:
    one end token.  Rows that repeat are documents of their own and count as
    often; rows with a null doc_id teach nothing and are held out.  With nothing
    learned every token is unknown.  An empty table gives no rows.
    """
    model, read = learned(docs)
    shared = ship(docs.sparkSession, model)
    texts = Staged(settled(read.df, settled_words(read.df, shared), shared), "settled")
    read.drop()
    m, words = settled_counts(texts.df)
    return scored(texts.df, model, m, words)


def scored(texts: DataFrame, model: Model, m: np.ndarray, words: np.ndarray) -> DataFrame:
    """Scores of texts whose tokens all have their classes."""
    shared = ship(texts.sparkSession, (transitions(m), rooms(m, words + model.words)))
    schema = T.StructType([
        T.StructField("doc_id", texts.schema["doc_id"].dataType.elementType), T.StructField("taught", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()), T.StructField("log", T.DoubleType()), T.StructField("model", T.DoubleType()),
    ])
    arrow = to_arrow_schema(schema, prefers_large_types=False)

    def run(batches):
        transition, room = shared()
        for b in batches:
            for i in range(b.num_rows):
                kinds, sizes = values_of(b, "kinds", i, np.uint8), values_of(b, "sizes", i, np.int32)
                before, log = np.concatenate([[CLASSES], kinds[:-1]]), values_of(b, "log", i, np.float64)
                part = np.add.reduceat(transition[before, kinds] - room[kinds], np.cumsum(sizes) - sizes)
                rows = [b.column(c)[i].values for c in ("doc_id", "taught")]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(sizes.astype(np.int64)), pa.array(values_of(b, "n_known", i, np.int64)), pa.array(log), pa.array(part + log)], schema=arrow)

    done = texts.select("doc_id", "taught", "sizes", "kinds", "n_known", "log").mapInArrow(run, schema)
    return done.select(
        "doc_id", (~F.col("taught")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("log") + F.col("n_tokens") * F.lit(model.base)).alias("base_score"), F.col("model").alias("score"), F.pow(F.lit(10.0), -F.col("model") / F.col("n_tokens")).alias("perplexity"),
    )
