"""Toxicity with a convolutional text classifier, trained in numpy (operator 9).

A word's vector is the sum of hashed embeddings of the word and of its first
four, five and six characters.  Filters of width one, two and three slide over
the words, rectified and max-pooled over the whole text; a logistic layer reads
the pools.  As a filter is linear, embeddings and filters fold into one table
for scoring: a word's share of each filter is a sum of table rows.  One shift of
the logit sets the score's working point at 0.3; thresholds by language then
refine the decision, not the score.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, remainder, ship
from .sampling import capped, thinned

BUCKETS = 1 << 15
PREFIXES = (4, 5, 6)
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 12
#: Labelled documents of each class that the model is fitted on, at most, and bytes of their words' places (eight a word).
PER_CLASS, CLASS_BYTES = 2400, 24 << 20
EPOCHS = 4
RATE = 0.08
THRESHOLD = 0.3
#: Words that a scoring worker remembers before it starts anew.
CACHE = 60_000
WORD = re.compile(r"[^\W\d_]+")


def buckets(word: str) -> list[int]:
    """Places of a word and its prefixes in the embedding table; BUCKETS is the place of none (zeros)."""
    named = [zlib.crc32(word.encode()) % BUCKETS]
    return named + [zlib.crc32(f"{word[:n]}-".encode()) % BUCKETS if len(word) > n - 1 else BUCKETS for n in PREFIXES]


def tokens(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Network:
    """Embeddings, filters by width and place, and the logistic layer."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.1, (BUCKETS + 1, DIM)).astype(np.float32)
        self.embed[BUCKETS] = 0
        self.filters = {(w, j): rng.normal(0, 0.3, (DIM, FILTERS)).astype(np.float32) for w in WIDTHS for j in range(w)}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.shift = 0.0
        self.thresholds: dict[str, float] = {}

    def pools(self, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Largest rectified response of each filter over n words, and where; x has two zero rows behind them."""
        top, where = [], []
        for w in WIDTHS:
            r = sum(x[j : n + j] @ self.filters[w, j] for j in range(w)) + self.bias[w]
            p = r.argmax(axis=0)
            where.append(p)
            top.append(np.maximum(r[p, np.arange(FILTERS)], 0))
        return np.concatenate(top), np.concatenate(where)

    def train(self, docs: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> None:
        """Adagrad, a text a step; the gradient passes through the pooled places alone."""
        rng = np.random.default_rng(seed)
        g2_embed = np.full(BUCKETS + 1, 1e-3, np.float32)
        g2 = {k: np.full_like(v, 1e-3) for k, v in self.filters.items()} | {w: np.full(FILTERS, 1e-3, np.float32) for w in WIDTHS}
        g2_out, g2_shift = np.full_like(self.out, 1e-3), 1e-3
        weight = {1: 0.5 / max(1, labels.sum()), 0: 0.5 / max(1, (1 - labels).sum())}
        for _ in range(epochs):
            for i in rng.permutation(len(docs)):
                b, y = docs[i], labels[i]
                n = len(b)
                if not n:
                    continue
                x = np.zeros((n + 2, DIM), np.float32)
                x[:n] = self.embed[b].sum(axis=1)
                pool, where = self.pools(x, n)
                p = 1 / (1 + np.exp(-(pool @ self.out + self.shift)))
                d = np.float32((p - y) * weight[int(y)] * len(docs))
                if abs(d) < 1e-3:
                    continue
                d_pool = d * self.out * (pool > 0)
                g = d * pool
                g2_out += g * g
                self.out -= RATE * g / np.sqrt(g2_out)
                g2_shift += d * d
                self.shift -= RATE * d / np.sqrt(g2_shift)
                for k, w in enumerate(WIDTHS):
                    dp, at = d_pool[k * FILTERS : (k + 1) * FILTERS], where[k * FILTERS : (k + 1) * FILTERS]
                    g2[w] += dp * dp
                    self.bias[w] -= RATE * dp / np.sqrt(g2[w])
                    for j in range(w):
                        f = self.filters[w, j]
                        seen = x[at + j]
                        step = f.T * dp[:, None]
                        g = seen.T * dp
                        g2[w, j] += g * g
                        f -= RATE * g / np.sqrt(g2[w, j])
                        for r in np.flatnonzero((at + j < n) & (dp != 0)):
                            rows = b[at[r] + j]
                            rows = rows[rows < BUCKETS]
                            g2_embed[rows] += (step[r] * step[r]).mean()
                            self.embed[rows] -= RATE * step[r] / np.sqrt(g2_embed[rows])[:, None]

    def raw(self, b: np.ndarray) -> float:
        """The logit of one text, from its bucket rows."""
        if not len(b):
            return float(self.shift)
        x = np.zeros((len(b) + 2, DIM), np.float32)
        x[: len(b)] = self.embed[b].sum(axis=1)
        return float(self.pools(x, len(b))[0] @ self.out + self.shift)

    def folded(self) -> Scorer:
        return Scorer({k: self.embed @ f for k, f in self.filters.items()}, self.bias, self.out, self.shift)


class Scorer:
    """Batch scoring with the folded tables; remembers a bounded number of words."""

    def __init__(self, tables: dict, bias: dict, out: np.ndarray, shift: float):
        self.tables, self.bias, self.out, self.shift = tables, bias, out, shift
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.shares = {k: [np.zeros((1, FILTERS), np.float32)] for k in self.tables}

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Scores in [0, 1]; a text without words has that of the bias."""
        if len(self.number) > CACHE:
            self.forget()
        number, had, flat, sizes = self.number, len(self.number), [], []
        for t in texts:
            w = tokens(t)
            for x in w:
                if x not in number:
                    number[x] = len(number)
            flat += [number[x] for x in w]
            flat += (0, 0)
            sizes.append(len(w))
        if len(number) > had:
            new = np.array([buckets(x) for x in list(number)[had:]])
            for k, table in self.tables.items():
                self.shares[k] = [np.concatenate([*self.shares[k], table[new].sum(axis=1)])]
        at, sizes = np.array(flat, np.int64), np.array(sizes)
        start = np.cumsum(sizes + 2) - sizes - 2
        full = np.flatnonzero(sizes)
        logit = np.full(len(texts), self.shift)
        if len(full):
            n = len(at) - 2
            word = np.ones(n, bool)  # the two places behind each text hold no window
            for back in (0, 1):
                place = (start + sizes + back)[:-1]
                word[place] = False
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])[full]
            for k, w in enumerate(WIDTHS):
                r = sum(self.shares[w, j][0][at[j : n + j][word]] for j in range(w)) + self.bias[w]
                pool = np.maximum(np.maximum.reduceat(r, first, axis=0), 0)
                logit[full] += pool @ self.out[k * FILTERS : (k + 1) * FILTERS]
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def best_cut(scores: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the best F1 score; the middle of the gap that it lies in."""
    if not labels.any():
        return float(scores.max(initial=0.5)) + 1e-6
    order = np.argsort(-scores, kind="stable")
    s, hit = scores[order], np.cumsum(labels[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + labels.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(f1.argmax())
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else s[k])) / 2)


def fit(labelled: DataFrame, per_class: int = PER_CLASS) -> Network:
    """Network of doc_id, text, lang, toxic rows; toxic must not be null.  lang only parts the thresholds.

    A fifth of the sample is kept from training and sets the working point and
    the thresholds by language.  Without both classes the network stays as drawn.
    """
    schema = T.StructType([labelled.schema["doc_id"], T.StructField("lang", T.StringType()), T.StructField("toxic", T.IntegerType()), T.StructField("words", T.BinaryType())])

    def of(b):
        words = [np.array([buckets(x) for x in tokens(t)], np.uint16).tobytes() for t in b.column("text").to_pylist()]
        return {"doc_id": b.column("doc_id"), "lang": b.column("lang"), "toxic": b.column("toxic"), "words": words}

    rows = labelled.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.col("toxic").cast("int").alias("toxic"))
    some = capped(map_texts(rows, of, schema), "toxic", per_class, "words", CLASS_BYTES).collect()
    some.sort(key=lambda r: (zlib.crc32(f"{r['doc_id']}/order".encode()), bytes(r["words"]), r["lang"] or ""))
    docs = [np.frombuffer(r["words"], np.uint16).reshape(-1, 1 + len(PREFIXES)).astype(np.int64) for r in some]
    labels = np.array([r["toxic"] for r in some], np.int64)
    net = Network()
    if labels.any() and not labels.all():
        kept = np.arange(len(docs)) % 5 == 0
        net.train([d for d, k in zip(docs, kept, strict=True) if not k], labels[~kept])
        held = [i for i in np.flatnonzero(kept)]
        logits = np.array([net.raw(docs[i]) for i in held])
        truth = labels[held]
        cut = float(np.clip(best_cut(logits, truth), -8, 8))
        net.shift += np.log(THRESHOLD / (1 - THRESHOLD)) - cut
        scores = 1 / (1 + np.exp(-np.clip(logits - cut + np.log(THRESHOLD / (1 - THRESHOLD)), -60, 60)))
        for lang in sorted({some[i]["lang"] for i in held if some[i]["lang"] is not None}):
            own = np.array([some[i]["lang"] == lang for i in held])
            # too few cases say nothing of their own: they keep the common threshold
            net.thresholds[lang] = float(np.clip(best_cut(scores[own], truth[own]), 0.05, 0.95)) if truth[own].sum() >= 10 else THRESHOLD
    return net


def score(docs: DataFrame, net: Network, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to keep, score: a row a document, from the whole text alone; null texts score as empty ones, rows that repeat stay."""
    shared = ship(docs.sparkSession, net.folded())
    kept = ("doc_id", *keep)
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("score", T.DoubleType())])
    return map_texts(docs.select(*kept, "text"), lambda b: {c: b.column(c) for c in kept} | {"score": shared().score(b.column("text").to_pylist())}, schema, chars=1 << 20)


def flagged(scored: DataFrame, net: Network, lang: str = "lang") -> DataFrame:
    """Add flagged: the score reaches its language's threshold (of no known language: the common one)."""
    at = F.lit(THRESHOLD)
    for name, cut in net.thresholds.items():
        at = F.when(F.col(lang) == name, cut).otherwise(at)
    return scored.withColumn("flagged", F.col("score") >= at)


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id, toxic: one row a document.  Labels other than 0 and 1, and null ids, teach nothing; of labels that differ the toxic one holds."""
    return labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, flagged (by the language's threshold): a row a document.

    Learned from labels whose crc32 remainder is known and not 2; documents with
    a null id are held out.  The sample is the documents' own places' first, so
    reruns learn the same.  Null and empty texts have the score of no word; rows
    that repeat stay; no documents give no rows.
    """
    rest = remainder(F.col("doc_id"), 4)
    taught = known_labels(labels.select("doc_id", "toxic").filter(rest != 2))
    few = taught.select("doc_id", "toxic", F.lit("").alias("none"))
    few = capped(thinned(few, "toxic", PER_CLASS), "toxic", PER_CLASS, "none", 0).drop("none")
    sample = docs.select("doc_id", "text", "lang").join(F.broadcast(few), "doc_id")  # 2 PER_CLASS ids, at most
    net = fit(sample)
    return flagged(score(docs, net, ("lang",)), net).select("doc_id", F.coalesce(rest == 2, F.lit(True)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "flagged")
