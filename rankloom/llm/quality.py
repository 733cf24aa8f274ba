"""Quality rules with suffix-array repetition (operator 8).

A batch of texts is one array of word numbers, numbered apart for each text, so
suffixes of different texts share no prefix.  Prefix doubling sorts the
suffixes, each round only those that still tie; the ranks of all rounds give
the longest common prefix of neighbours by descent.  An interval of the array
whose common prefix is ``l`` words is a repeated substring of ``l`` words, and
a suffix's longest one reaches as far as the larger of its two neighbours'
prefixes; so those reaches together cover what all maximal repeats cover.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, fresh, map_texts, words_of

#: Words of the shortest repeat that counts.
REPEAT_WORDS = 8
MIN_WORDS = 20
#: Percent of words in repeats that base rules allow.
BASE_PERCENT = 30
#: The method's limits: percent of word characters in repeats, and words of the longest repeat.
CHAR_PERCENT = 30
LONGEST_WORDS = 200
SYMBOLS = "#*$%&|<>"


def repeats(words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """For the texts' words end to end: longest repeat that starts at each word, and whether a repeat covers it."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n = int(sizes.sum())
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    numbers = np.empty(n, np.int64)
    at = base = 0
    for w in words:
        known: dict[str, int] = {}
        for x in w:
            known.setdefault(x, base + len(known))
        numbers[at : at + len(w)] = [known[x] for x in w]
        at, base = at + len(w), base + len(known)
    end = np.repeat(np.cumsum(sizes), sizes)
    sa = np.argsort(numbers, kind="stable")
    rank = np.empty(n, np.int64)
    fresh_group = np.concatenate([[True], np.diff(numbers[sa]) != 0])
    rank[sa] = np.maximum.accumulate(np.where(fresh_group, np.arange(n), 0))
    levels, h = [rank.astype(np.int32)], 1
    slots = tied(rank[sa], np.arange(n))
    while len(slots):
        pos = sa[slots]
        second = np.where(pos + h < end[pos], rank[np.minimum(pos + h, n - 1)] + 1, 0)
        key = rank[pos] * (n + 1) + second
        order = np.argsort(key, kind="stable")
        pos, key = pos[order], key[order]
        sa[slots] = pos
        new = np.concatenate([[True], np.diff(key) != 0])
        group = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        rank[pos] = group
        levels.append(rank.astype(np.int32))
        h *= 2
        slots = tied(group, slots)
    # common prefix of neighbours in the array, by descent through the rounds
    a, b = sa[:-1].copy(), sa[1:].copy()
    common = np.zeros(n + 1, np.int64)
    pairs = np.flatnonzero(levels[0][a] == levels[0][b]) if len(levels) > 1 else np.zeros(0, np.int64)
    for k in range(1, min(3, len(levels) - 1) + 1):  # fewer than eight words don't count: drop those early
        pairs = pairs[levels[k][a[pairs]] == levels[k][b[pairs]]]
    if len(levels) <= 3:
        pairs = pairs[:0]
    a, b, length = a[pairs], b[pairs], np.zeros(len(pairs), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < end[np.minimum(sa[pairs], n - 1)]) & (b < end[np.minimum(sa[pairs + 1], n - 1)])
        same = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        step = np.where(same, 1 << k, 0)
        a, b, length = a + step, b + step, length + step
    common[pairs + 1] = length
    longest = np.zeros(n, np.int64)
    longest[sa] = np.maximum(common[:-1], common[1:])
    longest[longest < REPEAT_WORDS] = 0
    starts = np.flatnonzero(longest)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + longest[starts], -1)
    return longest, np.cumsum(step[:-1]) > 0


def tied(group: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Slots whose group has another slot; groups stand together."""
    same = np.concatenate([[False], np.diff(group) == 0, [False]])
    return slots[same[:-1] | same[1:]]


def n_dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if WORD.search(x)] if "\n" in text else ()
    return len(lines) - len(set(lines))


MEASURES = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "repeat_chars": "long", "longest_repeat": "long"}


def measures(texts: list[str | None]) -> dict[str, np.ndarray]:
    """Counts of whole texts, a value a text; null texts have no words."""
    words = [words_of(t) for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    longest, covered = repeats(words)
    chars = np.fromiter((len(x) for w in words for x in w), np.int64, int(sizes.sum()))

    def by_text(x: np.ndarray, f=np.add) -> np.ndarray:
        out, full = np.zeros(len(texts), np.int64), np.flatnonzero(sizes)
        if len(full):
            out[full] = f.reduceat(x, (np.cumsum(sizes) - sizes)[full])
        return out

    return {
        "n_words": sizes,
        "word_chars": by_text(chars),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) if t else 0 for t in texts], np.int64),
        "n_dup_lines": np.array([n_dup_lines(t) if t else 0 for t in texts], np.int64),
        "n_repeat_words": by_text(covered.astype(np.int64)),
        "repeat_chars": by_text(np.where(covered, chars, 0)),
        "longest_repeat": by_text(longest, np.maximum),
    }


def verdict(m: dict) -> tuple:
    """base_failed and kept; for columns and for arrays alike."""
    base_failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > BASE_PERCENT * m["n_words"])
    failed = (100 * m["repeat_chars"] > CHAR_PERCENT * m["word_chars"]) | (m["longest_repeat"] > LONGEST_WORDS)
    return base_failed, ~(base_failed | failed)


def rate(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed and kept, a row a document.

    Null and empty texts have no words and fail; rows that repeat stay; other
    columns aren't read; an empty table gives no rows.
    """
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(k, T.LongType()) for k in MEASURES], T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])

    def of(b):
        m = measures(b.column("text").to_pylist())
        base_failed, kept = verdict(m)
        return {"doc_id": b.column("doc_id"), **m, "base_failed": base_failed, "kept": kept}

    return map_texts(docs.select("doc_id", "text"), of, schema, chars=4 << 20)


def good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns; one pass, no shuffle."""
    name = fresh(docs, "__kept")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.BooleanType())])

    def of(b):
        return {c: b.column(c) for c in b.schema.names} | {name: verdict(measures(b.column("text").to_pylist()))[1]}

    return map_texts(docs, of, schema, chars=4 << 20).filter(F.col(name)).drop(name)
