"""License scans by diagonal voting (operator 1, DataFrame functions only).

Every rolling k-gram of words in every text is hashed and joined to the
positions where the same k-gram stands in a license template.  A hit at word p
of the text and word q of the template votes for the diagonal p - q.  Votes are
summed by (text, template, diagonal) in runs of near places, runs of neighbouring
diagonals are merged (a word put in or left out shifts the rest by one) where
one goes on near where the other ends, in the text and in the template, and the
merged spans are verified.
The template table is fixed text of this module, so broadcasting it is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MARKS, lowered, word_array

# Phrases that a text must hold word for word, with their labels.
PHRASES = [
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
]
# Further notices, found word for word too.
NOTICES = [
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("bsd license", "bsd"),
    ("isc license", "isc"),
]
# Published license texts, found with gaps and small changes.
TEXTS = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
]

#: Words of a gram: of phrases and notices, and of whole texts.
SHORT_K, LONG_K = 2, 5
#: Runs of one span lie no further apart, by diagonals and by words.
DIAGONAL_GAP, WORD_GAP = 8, 32
#: A span of a whole text needs this share of its own grams and so many words.
SPAN_SHARE, SPAN_WORDS = 0.5, 12
SPAN_PERCENT = round(100 * SPAN_SHARE)

HERE = -1  # template of the row that each text has at least


def template_grams() -> list[tuple]:
    """(k, words of the gram padded with nulls, template, label, exact, base, words of the template, place)."""
    rows, number = [], 0
    named = [(label, text, SHORT_K, True, True) for text, label in PHRASES] + [(label, text, SHORT_K, True, False) for text, label in NOTICES] + [(label, text, LONG_K, False, False) for label, text in TEXTS]
    for label, text, k, exact, base in named:
        words = text.split()
        for place in range(len(words) - k + 1):
            gram = words[place : place + k]
            rows.append((k, *gram, *[None] * (LONG_K - k), number, label, exact, base, len(words), place))
        number += 1
    return rows


GRAM = [f"w{i}" for i in range(LONG_K)]
COLUMNS = ["k", *GRAM, "template", "label", "exact", "base", "length", "place"]


def gram_hash(k: int, words: list[Column]) -> Column:
    return F.xxhash64(F.lit(k), *words[:k])


def templates(spark) -> DataFrame:
    literal = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    values = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in template_grams())
    t = spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(COLUMNS)})")
    gram = [F.col(g) for g in GRAM]
    t = t.withColumn("hash", F.when(F.col("k") == SHORT_K, gram_hash(SHORT_K, gram)).otherwise(gram_hash(LONG_K, gram)))
    here = {"k": 0, "template": HERE, "exact": False, "base": False, "length": 0, "place": 0}
    return t.unionByName(spark.range(1).select(F.xxhash64(F.lit(0)).alias("hash"), *[F.lit(here.get(c)).cast(t.schema[c].dataType).alias(c) for c in COLUMNS]))


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans: array of (label, first word, last word, share of the span's grams
    that are those of the template), texts and notices alike.  score: the
    largest share of a template that the text covers.  Null or empty texts have
    no words, empty label strings and score 0; rows that repeat, ids that are
    null included, are documents of their own; other columns aren't read.
    """
    spark = docs.sparkSession
    words = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), word_array(lowered(F.col("text")), MARKS).alias("words"))
    words = words.withColumn("n_words", F.size("words"))
    rolling = [F.col("words")] + [F.slice("words", i + 1, F.greatest(F.col("n_words"), F.lit(1))) for i in range(1, LONG_K)]
    placed = words.select("doc_id", "row", "n_words", F.inline_outer(F.arrays_zip(F.sequence(F.lit(0), F.greatest(F.col("n_words") - 1, F.lit(0))).alias("p"), *[c.alias(g) for c, g in zip(rolling, GRAM, strict=True)])).alias("p", *GRAM))
    gram = [F.col(g) for g in GRAM]
    hashes = F.array(
        F.when(gram[SHORT_K - 1].isNotNull(), gram_hash(SHORT_K, gram)),
        F.when(gram[LONG_K - 1].isNotNull(), gram_hash(LONG_K, gram)),
        F.when(F.col("p") == 0, F.xxhash64(F.lit(0))),
    )
    grams = placed.select("doc_id", "row", "n_words", "p", *GRAM, F.explode(hashes).alias("hash")).filter("hash IS NOT NULL")
    t = F.broadcast(templates(spark).select("hash", "k", *[F.col(g).alias(f"t_{g}") for g in GRAM], "template", "label", "exact", "base", "length", "place"))
    same = [F.col("k") <= i for i in range(LONG_K)]
    right = F.lit(True)
    for i in range(LONG_K):  # equal hashes, and equal words too
        right = right & (same[i] | (F.col(f"t_w{i}") == gram[i]))
    hits = grams.join(t, "hash").filter(right)
    hits = hits.select("doc_id", "row", "n_words", "template", "label", "exact", "base", "length", "k", (F.col("p") - F.col("place")).alias("diagonal"), "p")
    key = ["doc_id", "row", "n_words", "template", "label", "exact", "base", "length", "k"]
    hits = hits.repartition("row")  # the one shuffle: all that follows is by row
    # votes of a diagonal, in runs of near places
    along = Window.partitionBy("row", "template", "diagonal").orderBy("p")
    hits = hits.withColumn("run", F.sum(F.when(F.col("p") - F.lag("p").over(along) > WORD_GAP, 1).otherwise(0)).over(along))
    # the best stretch of a run: votes less SPAN_PERCENT of its width are most, by prefix sums (from hit i to hit j: end(j) - begin(i))
    inside = Window.partitionBy("row", "template", "diagonal", "run").orderBy("p")
    hits = hits.withColumn("nth", F.row_number().over(inside).cast("long"))
    begin = F.struct((100 * (F.col("nth") - 1) - SPAN_PERCENT * (F.col("p") - 1)).alias("at"), "nth", "p")
    hits = hits.withColumn("begin", F.min(begin).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    stretch = F.struct((100 * F.col("nth") - SPAN_PERCENT * F.col("p") - F.col("begin.at")).alias("gain"), (F.col("nth") - F.col("begin.nth") + 1).alias("votes"), F.col("begin.p").cast("long").alias("first"), F.col("p").cast("long").alias("last"))
    runs = hits.groupBy(*key, "diagonal", "run").agg(F.count("*").alias("votes"), F.min("p").alias("first"), F.max("p").alias("last"), F.max(stretch).alias("stretch"))
    # bands of neighbouring diagonals; in a band a run goes on with the span before it if it is near it and further on in the template
    across = Window.partitionBy("row", "template").orderBy("diagonal", "run")
    runs = runs.withColumn("band", F.sum(F.when(F.col("diagonal") - F.lag("diagonal").over(across) > DIAGONAL_GAP, 1).otherwise(0)).over(across))
    ahead = Window.partitionBy("row", "template", "band").orderBy("first", "diagonal")
    shift, step = F.col("diagonal") - F.lag("diagonal").over(ahead), F.col("first") - F.lag("last").over(ahead)
    goes_on = ~F.col("exact") & (F.abs(shift) <= DIAGONAL_GAP) & (step <= WORD_GAP) & (F.col("first") - F.col("diagonal") > F.lag(F.col("last") - F.col("diagonal")).over(ahead))
    runs = runs.withColumn("new", F.when(goes_on, 0).otherwise(1))
    runs = runs.withColumn("span", F.sum("new").over(ahead))
    spans = runs.groupBy(*key, "band", "span").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), (F.max("last") + F.col("k") - 1).alias("last"), F.max(F.struct("stretch.votes", "stretch.first", "stretch.last", "stretch.gain")).alias("stretch"))
    width = F.col("last") - F.col("first") + 1
    grams_in = F.greatest(width - F.col("k") + 1, F.lit(1))
    share = F.least(F.col("votes") / grams_in, F.lit(1.0))
    found = F.when(F.col("exact"), F.col("votes") == F.col("length") - F.col("k") + 1).otherwise((share >= SPAN_SHARE) & (width >= SPAN_WORDS))
    # a span that fails as a whole may still hold a stretch that doesn't
    good = ~F.col("exact") & ~found & (F.col("stretch.gain") >= 0) & (F.col("stretch.last") - F.col("stretch.first") + F.col("k") >= SPAN_WORDS)
    better = lambda part, c: F.when(good, part).otherwise(F.col(c)).alias(c)
    spans = spans.select(*key, better(F.col("stretch.votes"), "votes"), better(F.col("stretch.first"), "first"), better(F.col("stretch.last") + F.col("k") - 1, "last"))
    covered = F.least(F.col("votes") / (F.col("length") - F.col("k") + 1), F.lit(1.0))
    spans = spans.filter((F.col("template") == HERE) | found).withColumns({"share": share, "covered": covered, "real": F.col("template") != HERE})
    is_base = F.col("base") & F.col("real")
    return spans.groupBy("doc_id", "row", "n_words").agg(
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("real"), F.col("label")))), ",").alias("labels"),
        F.round(F.coalesce(F.max(F.when(F.col("real"), F.col("covered"))), F.lit(0.0)), 9).alias("score"),
        F.collect_list(F.when(F.col("real"), F.struct("label", "first", "last", "share"))).alias("spans"),
    ).select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def oracle_sql() -> str:
    """The same rows by list positions, template after template."""
    phrase = lambda t: "[" + ", ".join(f"'{w}'" for w in t.split()) + "]"
    exact = [(i, label, text, i < len(PHRASES)) for i, (text, label) in enumerate(PHRASES + NOTICES)]
    long = [(len(exact) + i, label, text) for i, (label, text) in enumerate(TEXTS)]
    values = ", ".join(f"({n}, '{label}', {phrase(text)}, {base})" for n, label, text, base in exact)
    texts = ", ".join(f"({n}, '{label}', {phrase(text)})" for n, label, text in long)
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT * FROM (VALUES {values}) AS t(template, label, words, base)),
u AS (SELECT row, w, unnest(range(0, len(w))) AS i FROM d),
e AS (SELECT u.row, p.template, p.label, p.base, u.i FROM u JOIN p ON w[i + 1] = p.words[1] AND list_slice(w, i + 1, i + len(p.words)) = p.words),
x AS (SELECT * FROM (VALUES {texts}) AS t(template, label, words)),
xg AS (SELECT template, label, len(words) AS length, q, array_to_string(list_slice(words, q + 1, q + {LONG_K}), ' ') AS gram
       FROM (SELECT template, label, words, unnest(range(0, len(words) - {LONG_K - 1})) AS q FROM x)),
g AS (SELECT row, i, array_to_string(list_slice(w, i + 1, i + {LONG_K}), ' ') AS gram FROM u WHERE i + {LONG_K} <= len(w)),
h AS (SELECT row, template, label, length, i - q AS diagonal, i FROM g JOIN xg USING (gram)),
v0 AS (SELECT *, sum(far) OVER (PARTITION BY row, template, diagonal ORDER BY i ROWS UNBOUNDED PRECEDING) AS run
      FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY row, template, diagonal ORDER BY i) > {WORD_GAP} THEN 1 ELSE 0 END AS far FROM h)),
v1 AS (SELECT *, row_number() OVER (PARTITION BY row, template, diagonal, run ORDER BY i) AS nth FROM v0),
v AS (SELECT *, min(struct_pack(at := 100 * (nth - 1) - {SPAN_PERCENT} * (i - 1), nth := nth, p := i)) OVER (PARTITION BY row, template, diagonal, run ORDER BY i ROWS UNBOUNDED PRECEDING) AS b FROM v1),
r AS (SELECT row, template, label, length, diagonal, run, count(*) AS votes, min(i) AS first, max(i) AS last, max(struct_pack(gain := 100 * nth - {SPAN_PERCENT} * i - b.at, votes := nth - b.nth + 1, first := b.p, last := i)) AS t FROM v GROUP BY ALL),
b AS (SELECT *, sum(far) OVER (PARTITION BY row, template ORDER BY diagonal, run ROWS UNBOUNDED PRECEDING) AS band
      FROM (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY row, template ORDER BY diagonal, run) > {DIAGONAL_GAP} THEN 1 ELSE 0 END AS far FROM r)),
n AS (SELECT *, CASE WHEN abs(diagonal - lag(diagonal) OVER o) <= {DIAGONAL_GAP} AND first - lag(last) OVER o <= {WORD_GAP} AND first - diagonal > lag(last - diagonal) OVER o THEN 0 ELSE 1 END AS new
      FROM b WINDOW o AS (PARTITION BY row, template, band ORDER BY first, diagonal)),
s AS (SELECT *, sum(new) OVER (PARTITION BY row, template, band ORDER BY first, diagonal ROWS UNBOUNDED PRECEDING) AS span FROM n),
m AS (SELECT row, template, label, length, band, span, sum(votes) AS votes, min(first) AS first, max(last) + {LONG_K - 1} AS last, max(struct_pack(votes := t.votes, first := t.first, last := t.last, gain := t.gain)) AS t FROM s GROUP BY ALL),
f AS (SELECT row, label, least(votes / (length - {LONG_K - 1}), 1.0) AS covered FROM m
      WHERE last - first + 1 >= {SPAN_WORDS} AND least(votes / greatest(last - first + 1 - {LONG_K - 1}, 1), 1.0) >= {SPAN_SHARE}
      UNION ALL SELECT row, label, least(t.votes / (length - {LONG_K - 1}), 1.0) FROM m
      WHERE NOT (last - first + 1 >= {SPAN_WORDS} AND least(votes / greatest(last - first + 1 - {LONG_K - 1}, 1), 1.0) >= {SPAN_SHARE}) AND t.gain >= 0 AND t.last - t.first + {LONG_K} >= {SPAN_WORDS}),
l AS (SELECT row, label, base, i, 1.0 AS covered FROM e UNION ALL SELECT row, label, false, NULL, covered FROM f)
SELECT doc_id, CAST(len(any_value(w)) AS BIGINT) AS n_words, count(i) FILTER (base) AS n_base,
       CAST(min(i) FILTER (base) AS BIGINT) AS first_word, CAST(max(i) FILTER (base) AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (label IS NOT NULL))), ','), '') AS labels,
       CAST(round(coalesce(max(covered), 0), 9) AS DOUBLE) AS score
FROM d LEFT JOIN l USING (row) GROUP BY row, doc_id
"""
