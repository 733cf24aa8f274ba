"""Merkle manifests, ranked search and packing against brute force, and their edges."""

import random
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_oracles import against
from tokenizers import Tokenizer

from rankloom.llm import merkle, packing, search
from rankloom.llm.common import Staged, prefix_sums

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_prefix_sums(spark):
    rows = [(g, i, (i * 7) % 5) for g in ("a", "b") for i in range(0, 50, 1 + (g == "b"))]
    got = prefix_sums(spark.createDataFrame(rows, "g string, i long, n long"), ["g"], "i", "n", "upto", block=8).collect()
    want = {(g, i): sum(n for h, j, n in rows if h == g and j < i) for g, i, _ in rows}
    assert {(r["g"], r["i"]): r["upto"] for r in got} == want and len(got) == len(rows)


# --- manifests ---


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_levels(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_mountain_range_merges_any_cut(fanout):
    draw = random.Random(fanout)
    for n in [1, 2, 3, 7, 8, 9, 27, 64, 65, 100, 243]:
        leaves = [h(str(i)) for i in range(n)]
        cuts = [0, *sorted(draw.sample(range(1, n), min(n - 1, 4))), n]
        peaks, made = [], {}
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = merkle.MountainRange(fanout)
            for i in range(a, b):
                part.push(0, i, leaves[i])
            peaks += part.peaks
            made |= {x[:2]: x[2] for x in part.made}
        whole = merkle.MountainRange(fanout)
        for x in peaks:
            whole.push(*x)
        levels = plain_levels(leaves, fanout)
        assert whole.close() == (len(levels) - 1, 0, levels[-1][0])
        made |= {x[:2]: x[2] for x in whole.made}
        assert made == {(i, j): x for i, level in enumerate(levels) for j, x in enumerate(level) if i}


@pytest.mark.parametrize("fanout,part_rows,chunk_rows", [(2, 5, 4), (3, 11, 9), (4, 1000, 4096)])
def test_manifest_against_plain_trees(spark, sf_dir, fanout, part_rows, chunk_rows, monkeypatch):
    monkeypatch.setattr(merkle, "MERGED", 3)  # several rounds of merging
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(150)
    docs = Staged(docs.unionByName(docs.limit(9)), "docs").df
    made = merkle.manifest(docs, fanout, part_rows)
    by = {}
    for r in docs.collect():
        cells = [r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]]
        own = h(*["-" if c is None else f"{len(str(c).encode())}:{c}" for c in cells])
        by.setdefault("" if r["lang"] is None else "=" + r["lang"], []).append((r["doc_id"], own))
    trees = {g: plain_levels([x[1] for x in sorted(rows)], fanout) for g, rows in by.items()}
    want = {(g, i, j): x for g, levels in trees.items() for i, level in enumerate(levels) for j, x in enumerate(level)}
    assert {(r["g"], r["level"], r["idx"]): r["digest"] for r in made.documents.nodes.collect()} == want
    assert made.root == plain_levels([trees[g][-1][0] for g in sorted(trees, key=str.encode)], fanout)[-1][0]
    rows = merkle.verify(docs, fanout, part_rows, chunk_rows).collect()
    assert len(rows) == docs.count()
    assert all(r["verified"] == bool(zlib.crc32(str(r["doc_id"]).encode()) % 7) and r["root"] == made.root for r in rows)


def test_odd_manifests(spark, odd_docs, no_docs):
    with_chars = odd_docs.selectExpr("*", "if(doc_id = 3, NULL, length(text)) AS n_chars")
    against(merkle.verify(with_chars, part_rows=3, chunk_rows=2), merkle.oracle_sql(), documents=with_chars.select("doc_id", "text", "lang", "source", "n_chars"))
    assert merkle.verify(with_chars.limit(0)).count() == 0
    one = with_chars.filter("doc_id = 2")
    row = merkle.verify(one).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == h()


def test_equal_rows_spread_over_partitions(spark):
    docs = spark.range(400).selectExpr("CAST(NULL AS LONG) AS doc_id", "'same' AS text", "'en' AS lang", "'a' AS source", "4L AS n_chars")
    made = merkle.manifest(docs, part_rows=50)
    assert made.documents.spans.count() > 4
    assert made.root == plain_levels([h("-", "1:a", "2:en", "1:4", "4:same")] * 400, 2)[-1][0]


# --- search ---


def test_odd_search(spark, odd_docs, no_docs, monkeypatch):
    items = spark.createDataFrame([(1, "license of the MIT"), (1, "public"), (2, None), (3, " .,"), (None, "one two ÜNïcode words"), (4, "unheard"), (5, " ".join(f"w{i}x{i}" for i in range(900)))], "item_id long, text string")
    for terms in (4, 300_000):
        monkeypatch.setattr(search, "BLOCK_TERMS", terms)
        got = search.search(odd_docs, items)
        against(got, search.ORACLE_SQL, documents=odd_docs.select("doc_id", "text"), benchmark=items)
    assert got.filter("item_id IS NULL").count() > 0
    assert search.search(no_docs, items).count() == 0 and search.search(odd_docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("share", [0.0, 0.4, 1.0])
def test_search_prunes_nothing_that_counts(spark, monkeypatch, share):
    """Many ties, repeated texts, terms of very different frequency, fewer than k documents for some."""
    draw = random.Random(5)
    words = [f"t{i}" for i in range(60)]
    texts = [" ".join(draw.choices(words, [1 / (i + 1) for i in range(60)], k=draw.randint(1, 40))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:80])], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(draw.sample(words, 8))) for i in range(25)], "item_id long, text string")
    monkeypatch.setattr(search.essential, "__defaults__", (share,))
    monkeypatch.setattr(search, "CELLS", 1000)
    against(search.search(docs, items), search.ORACLE_SQL, documents=docs, benchmark=items)


# --- packing ---


def best_fit_by_piece(lengths, capacity):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, x in enumerate(left) if x >= n]
        i = min(fits, key=lambda i: left[i]) if fits else len(left)
        if i == len(left):
            left.append(capacity)
        left[i] -= n
    return sorted(left)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=120))
def test_best_fit_is_that_of_pieces(lengths):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    plan, opened = packing.best_fit(histogram, 30)
    used, plan = {}, sorted(plan)
    for length, n in histogram.items():
        runs = [p for p in plan if p[0] == length]
        for k in range(n):
            _, first, each, sequence, offset = [p for p in runs if p[1] <= k][-1]
            place = (sequence + (k - first) // each, offset + (k - first) % each * length)
            assert place not in used
            used[place] = length
    ends = [0] * opened
    for (s, at), n in sorted(used.items()):
        assert ends[s] == at
        ends[s] += n
    assert sorted(30 - x for x in ends) == best_fit_by_piece(lengths, 30)


ODD = ["", " ", "one\x1ctwo\x85three four ÀÉ", "It's we'll I'D don't", "à ̀b é\né", "<|endoftext|> x<|startoftext|>y", "ΟΔΥΣΣΕΥΣ ΣΑΣ ΣΑΣ.", "x" * 300 + " " + "日本語" * 50, "tabs\tand\x0bodd\x0cends\r\n 1234 ½ ﬁ İstanbul", "a\u0000b", "ŉe ſtraße Ǆǅ ÀÉ,Ünï's ×÷ a½b İx ¿qué?'S", "'s't 'LL \u00a0x\u00a0", "<a> < b <|endoftext|"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(), st.sampled_from(ODD)), min_size=1, max_size=12))
def test_words_give_the_ids_of_whole_texts(texts):
    import pyarrow as pa

    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, begins = WORDS.encode(pa.array([*texts, None], pa.string()))
    want = [e.ids for e in WHOLE.encode_batch(texts, add_special_tokens=False)] + [[]]
    assert [list(ids[a:b]) for a, b in zip(begins, begins[1:], strict=False)] == want


with open(TOKENIZER, encoding="utf-8") as f:
    WORDS = packing.WordTokenizer(f.read())
WHOLE = Tokenizer.from_file(TOKENIZER)


def check_packed(docs, rows, capacity):
    whole = sorted([(str(r["doc_id"]), [*WHOLE.encode(r["text"] or "", add_special_tokens=False).ids, 0]) for r in docs.collect()])
    want = sorted((d, p, s, len(ids[s : s + capacity]), zlib.crc32(np.array(ids[s : s + capacity], "<u4").tobytes())) for d, ids in whole for p, s in enumerate(range(0, len(ids), capacity)))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert bins.setdefault(r["sequence_id"], 0) == r["offset"]
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= capacity and sorted(capacity - x for x in bins.values()) == best_fit_by_piece([r["length"] for r in rows], capacity)


def test_packing(spark, sf_dir, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)
    check_packed(docs, packing.pack(docs, TOKENIZER).collect(), 2048)
    check_packed(docs, packing.pack(docs, TOKENIZER, capacity=100).collect(), 100)
    check_packed(odd_docs, packing.pack(odd_docs, TOKENIZER, capacity=16).collect(), 16)
    assert packing.pack(no_docs, TOKENIZER).count() == 0


def test_packed_sequences_hold_their_ids(spark, odd_docs):
    packed = Staged(packing.pack(odd_docs.filter("doc_id IS NOT NULL AND doc_id <> 1"), TOKENIZER, capacity=32, with_ids=True), "packed").df
    held = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        own = held[r["sequence_id"]]["ids"][r["offset"] : r["offset"] + r["length"]]
        assert own == r["ids"] and zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"]


def test_forgetting_words_changes_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 31 + j) % 211}" for j in range(40))) for i in range(60)], "doc_id long, text string").repartition(1)
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    import pyarrow as pa

    with open(TOKENIZER, encoding="utf-8") as f:
        small = packing.WordTokenizer(f.read())
    texts = [r["text"] for r in docs.collect()]
    for t in texts:
        ids, _ = small.encode(pa.array([t]))
        assert list(ids) == WHOLE.encode(t, add_special_tokens=False).ids
