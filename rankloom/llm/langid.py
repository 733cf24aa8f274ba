"""Language identification with string kernels (operator 4).

The kernel of two texts is the number of character n-grams (n from 1 to 4)
that both hold, whatever their counts, over the root of the product of their
own numbers: a blended-spectrum presence kernel.  Nyström landmarks stand for
the whole kernel matrix, and kernel ridge regression, one language against the
rest, gives each landmark a weight a language.  As the kernel is a product of
presence vectors, landmarks and weights fold into one matrix (n-grams by
languages), and a batch of texts is scored by one matrix product.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, map_texts, remainder, ship
from .sampling import capped, thinned

N = (1, 2, 3, 4)
BITS = 17  # of an n-gram's place in the presence vector
#: Documents a language that the model is fitted on, at most, and bytes of their n-grams' places.
PER_LANGUAGE, LANGUAGE_BYTES = 400, 32 << 20
#: Landmarks a language.
LANDMARKS = 32
RIDGE = 1e-2
SHARPNESS = 6.0
UNKNOWN = "und"
#: Less certain texts are rejected as of no known language.
MIN_SCORE = 0.3
BATCH = 64
SIGN = re.compile(r"[^\W\d_]")
MIX = np.uint64(0x9E3779B97F4A7C15)


def has_letter(text: str | None) -> bool:
    """Some character is of a letter category; signs such as a half or a circled one are word characters, but no letters."""
    return bool(text) and any(m[0].isalpha() for m in SIGN.finditer(text))


def presence(text: str, out: np.ndarray) -> None:
    """Set the places of a text's n-grams in a row of zeros (uint8)."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(len(cp), np.uint64)
    for n in range(1, max(N) + 1):
        if len(cp) < n:
            return
        h = (h[: len(cp) - n + 1] + np.uint64(n)) * MIX
        h ^= h >> np.uint64(29)
        h += cp[n - 1 :]
        if n in N:
            out[(h * MIX) >> np.uint64(64 - BITS)] = 1


class Model:
    """Languages and the folded matrix of presence weights."""

    def __init__(self, languages: list[str], columns: np.ndarray, weights: np.ndarray):
        self.languages, self.columns, self.weights = languages, columns, weights

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        known = [i for i, t in enumerate(texts) if has_letter(t)]
        x = np.zeros((BATCH, 1 << BITS), np.uint8)
        for at in range(0, len(known), BATCH):
            some = known[at : at + BATCH]
            x[: len(some)] = 0
            for row, i in enumerate(some):
                presence(texts[i], x[row])
            rows = x[: len(some)]
            size = np.sqrt(np.maximum(np.count_nonzero(rows, axis=1), 1))[:, None]
            f = rows[:, self.columns].astype(np.float32) @ self.weights / size
            p = np.exp(SHARPNESS * (f - f.max(axis=1, keepdims=True)))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            for row, i in enumerate(some):
                names[i], scores[i] = self.languages[best[row]], p[row, best[row]]
        return names, scores


def solve(features: list[np.ndarray], labels: list[str]) -> Model:
    """Ridge regression in the landmarks' span, from the n-gram places of each sample text."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32))
    y = np.array([[1.0 if lang == x else -1.0 for x in languages] for lang in labels])
    marks = [i for lang in languages for i in [k for k, x in enumerate(labels) if x == lang][:LANDMARKS]]
    columns = np.unique(np.concatenate([features[i] for i in marks]))
    place = np.full(1 << BITS, -1)
    place[columns] = np.arange(len(columns))
    land = np.zeros((len(marks), len(columns)), np.float32)
    for row, i in enumerate(marks):
        land[row, place[features[i]]] = 1 / np.sqrt(len(features[i]))
    k = np.zeros((len(features), len(marks)))
    for row, x in enumerate(features):
        inside = place[x]
        k[row] = land[:, inside[inside >= 0]].sum(axis=1) / np.sqrt(max(len(x), 1))
    k_mm = k[marks]
    rows_of = np.array([1.0 / labels.count(x) for x in labels])[:, None]  # each language weighs the same
    a = k.T @ (rows_of * k) + RIDGE * (k_mm + k_mm.T) / 2 / len(marks) + 1e-8 * np.eye(len(marks))
    alpha = np.linalg.solve(a, k.T @ (rows_of * y))
    return Model(languages, columns, (land.T @ alpha).astype(np.float32))


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Model of doc_id, text, lang rows; rows with a null lang or without a letter teach nothing."""
    rows = thinned(labelled.select("doc_id", "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL"), "lang", per_language)
    schema = T.StructType([labelled.schema["doc_id"], T.StructField("lang", T.StringType()), T.StructField("grams", T.BinaryType())])

    def of(b):
        grams, row = [], np.zeros(1 << BITS, np.uint8)
        for t in b.column("text").to_pylist():
            row[:] = 0
            if has_letter(t):
                presence(t, row)
            grams.append(np.flatnonzero(row).astype(np.int32).tobytes())
        return {"doc_id": b.column("doc_id"), "lang": b.column("lang"), "grams": grams}

    some = capped(map_texts(rows, of, schema).filter("octet_length(grams) > 0"), "lang", per_language, "grams", LANGUAGE_BYTES).collect()
    some.sort(key=lambda r: (r["lang"], str(r["doc_id"])))
    return solve([np.frombuffer(r["grams"], np.int32) for r in some], [r["lang"] for r in some])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, a row a document, from the text alone.

    Null texts and those without a letter are "und" with score 0; so is all if
    nothing was learned.  Rows that repeat stay; an empty table gives no rows.
    """
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = ship(docs.sparkSession, model)

    def of(b):
        names, scores = shared().predict(b.column("text").to_pylist())
        return {"doc_id": b.column("doc_id"), "lang_pred": names, "score": scores}

    return map_texts(docs.select("doc_id", "text"), of, schema)


def in_training(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id, 5) != 0, F.lit(False))


def predictions(docs: DataFrame) -> DataFrame:
    """identify() with a model of the rows whose crc32 remainder isn't 0; held_out tells the others (and null ids) apart."""
    model = fit(docs.filter(in_training(F.col("doc_id"))))
    found = identify(docs, model)
    return found.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame) -> DataFrame:
    """The documents of some learned language, with all their columns, whatever these are called; those of none go.  One pass, no shuffle.

    Of no language are texts that are null or without a letter, and those whose
    best language scores below MIN_SCORE, the stage's rule.  Nothing learned,
    nothing kept; rows that repeat stay or go alike; an empty table gives no rows.
    """
    model = ship(docs.sparkSession, fit(docs.filter(in_training(F.col("doc_id")))))
    name = fresh(docs, "__known")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.BooleanType())])

    def of(b):
        names, scores = model().predict(b.column("text").to_pylist())
        return {c: b.column(c) for c in b.schema.names} | {name: [n != UNKNOWN and s >= MIN_SCORE for n, s in zip(names, scores, strict=True)]}

    return map_texts(docs, of, schema).filter(F.col(name)).drop(name)
