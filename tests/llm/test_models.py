"""Operators that SQL can't express, against brute force and held-out rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from rankloom.llm import brown, langid, quality, simhash, similar, toxicity
from rankloom.llm.common import ascii_lower, words_of


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held(doc_id, n, k):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % n == k


# --- words --------------------------------------------------------------------------


def test_words_split_on_seven_characters_only():
    assert words_of("a\x1cb\x85c d\xa0e\tf\x0bg\n\rh") == ["a\x1cb\x85c", "d\xa0e", "f", "g", "h"]
    assert words_of(None) == words_of(" \n") == []
    assert ascii_lower("ÀB \u212a") == "Àb \u212a"


# --- quality ------------------------------------------------------------------------


def brute_cover(w, n=8):
    c = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return {i + j for i in range(len(w) - n + 1) if c[tuple(w[i : i + n])] > 1 for j in range(n)}


def brute_longest(w):
    best = 0
    for n in range(8, len(w)):
        if len({tuple(w[i : i + n]) for i in range(len(w) - n + 1)}) == len(w) - n + 1:
            break
        best = n
    return best


def test_suffix_array_against_brute_force():
    rng = random.Random(5)
    for _ in range(120):
        batch = [[rng.choice("ab" if rng.random() < 0.7 else "abcdefgh") for _ in range(rng.choice([0, 1, 5, 9, 30, 80]))] for _ in range(4)]
        batch[1] = batch[1] * 2
        longest, covered = quality.repeats(batch)
        at = 0
        for w in batch:
            assert set(np.flatnonzero(covered[at : at + len(w)])) == brute_cover(w)
            assert longest[at : at + len(w)].max(initial=0) == brute_longest(w)
            at += len(w)


def test_quality_on_all_documents(docs):
    got = {r["doc_id"]: r for r in quality.rate(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        w, g = words_of(r["text"]), got[r["doc_id"]]
        lines = [x for x in r["text"].split("\n") if words_of(x)]
        n = len(brute_cover(w))
        assert (g["n_words"], g["word_chars"], g["n_dup_lines"], g["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), n)
        assert g["n_symbols"] == sum(c in "#*$%&|<>" for c in r["text"])
        assert g["base_failed"] == (len(w) < 20 or 100 * n > 30 * len(w)) and not (g["kept"] and g["base_failed"])


def test_odd_quality(odd_docs, no_docs):
    rows = quality.rate(odd_docs).collect()
    assert len(rows) == odd_docs.count() and sum(r["kept"] for r in rows) == 1  # the long one
    kept = quality.good(odd_docs)
    assert kept.columns == odd_docs.columns and [r["doc_id"] for r in kept.collect()] == [5]
    assert quality.rate(no_docs).count() == quality.good(no_docs).count() == 0


def test_limits_of_the_method(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage, filler = [word() for _ in range(250)], [word() for _ in range(3000)]
    docs = spark.createDataFrame([(1, " ".join(passage + filler + passage)), (2, " ".join(passage[:60] + filler + passage[:60])), (3, " ".join(filler))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.rate(docs).collect()}
    assert got[1]["longest_repeat"] == 250 and not got[1]["base_failed"] and not got[1]["kept"]
    assert got[2]["kept"] and got[3]["kept"] and got[2]["n_repeat_words"] == 120


# --- SimHash ------------------------------------------------------------------------


def plain_fingerprint(text):
    w = words_of(ascii_lower(text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """(id, fingerprint) pairs to the smallest id of each one's component."""
    a = np.array([f for _, f in fps], np.uint64)
    u, v = np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= 2)
    label = simhash.forest(u, v, len(a))
    least = {}
    for (i, _), k in zip(fps, label, strict=True):
        if i is not None:
            least[k] = min(i, least.get(k, i))
    return [least.get(k) for k in label]


def check_components(df):
    rows = df.select("doc_id", "text").collect()
    fps = [(r["doc_id"], plain_fingerprint(r["text"])) for r in rows]
    want = sorted(map(str, zip([i for i, _ in fps], [f"{f:016x}" for _, f in fps], plain_components(fps), strict=True)))
    assert sorted(str(tuple(r)) for r in simhash.near_duplicates(df).collect()) == want


def test_components_of_all_documents(docs):
    check_components(docs)


def test_odd_components(odd_docs, no_docs):
    check_components(odd_docs)
    assert simhash.near_duplicates(no_docs).count() == similar.dedup(no_docs).count() == 0
    kept = similar.dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    # one of the two rows of 1, one of the wordless, the long one, the others, and rows without an id
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "5", "6", "7", "None", "None"])


def test_bit_sliced_blocks():
    rng = random.Random(2)
    seed = rng.getrandbits(64)
    close = [seed ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(700)]
    fps = np.array(sorted(set(close + [rng.getrandbits(64) for _ in range(700)])), np.uint64)
    rng2 = np.random.default_rng(0)
    fps = fps[rng2.permutation(len(fps))]

    def brute(x):
        return simhash.forest(*np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 2), len(x))

    assert (simhash.linked_large(fps) == brute(fps)).all()
    sizes, at = np.array([1, 2, 300, 64, 65, 3, 465]), 0
    roots = simhash.linked_runs(fps[: sizes.sum()], sizes)
    for n in sizes:
        assert (roots[at : at + n] - at == brute(fps[at : at + n])).all()
        at += n


def test_chains_become_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (200, 150)], "u long, v long")
    stars = {r["u"]: r["v"] for r in simhash.components(links).df.collect()}
    assert stars == {i: 0 for i in range(1, 61)} | {150: 100, 200: 100}


def plain_groups(rows):
    """(doc_id, text) rows to the doc_ids that stay: smallest of each group linked by two bits or five-word similarity 0.8."""
    ids = sorted({i for i, _ in rows})
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, t in rows if (w := words_of(ascii_lower(t or "")))}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def join(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    for (i, _), k in zip(rows, plain_components([(i, plain_fingerprint(t)) for i, t in rows]), strict=True):
        join(i, k)
    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    first = {}
    for i, s in sorted(sets.items()):
        join(i, first.setdefault(s, i))
    unlike = set(first.values())
    shared = Counter()
    for held_by in holders.values():
        own = sorted(unlike.intersection(held_by))
        shared.update((a, b) for n, a in enumerate(own) for b in own[n + 1 :])
    for (a, b), n in shared.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            join(a, b)
    return {i for i in ids if find(i) == i}


def test_similar_texts_make_one_group(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, number = [], iter(range(10_000))
    for size, length, edits in [(2, 300, 5), (2, 300, 13), (40, 120, 2), (3, 30, 1), (3, 3000, 40), (2, 4, 1), (2, 200, 0)]:
        seed = [word() for _ in range(length)]
        for _ in range(size):
            w = list(seed)
            for k in rng.sample(range(length), edits):
                w[k] = word()
            rows.append((next(number), " ".join(w)))
    passage = [word() for _ in range(60)]  # shared by texts that are otherwise unlike
    for n in [20, 40, 200] * 20:
        rows.append((next(number), " ".join(passage + [word() for _ in range(n)])))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_groups(rows)
    assert {r["doc_id"] for r in similar.dedup(docs).collect()} == want and 60 < len(want) < 110


def test_large_blocks_and_rounds(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    monkeypatch.setattr(similar, "WHOLE_BLOCK", 10)
    monkeypatch.setattr(similar, "ONE_TASK", 0)
    rows, text = [], [word() for _ in range(150)]
    for i in range(90):  # a chain: neighbours are similar, its ends aren't
        text[rng.randrange(150)] = word()
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in similar.dedup(docs).collect()} == plain_groups(rows)


def test_distances_of_five_digits():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for k in range(1, 300):  # distances of all sizes
        flips = rng.choice(64, k % 40, replace=False)
        fps[k] = fps[0] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64), initial=np.uint64(0))
    lanes, valid, _, _ = simhash.lanes_of(fps, np.array([300]))
    got = {(int(a), int(b)) for who, lane in similar.close_pairs(np.arange(300), fps, simhash.planes_of(lanes), valid) for a, b in zip(who, lane, strict=True)}
    u, v = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= similar.WIDE)
    assert got == set(zip(u.tolist(), v.tolist(), strict=True))


# --- Brown scoring --------------------------------------------------------------------


def check_base(df):
    texts = [(r["doc_id"], words_of(ascii_lower(r["text"] or "")) + [" "]) for r in df.select("doc_id", "text").collect()]
    count = Counter(w for i, ws in texts if not held(i, 5, 1) for w in ws)
    total, distinct = sum(count.values()), len(count)
    want = sorted((str(i), held(i, 5, 1), len(ws), sum(count[w] > 0 for w in ws), total, round(sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws), 6)) for i, ws in texts)
    rows = brown.score(df).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == want
    return rows


def test_base_scores_and_held_out_perplexity(docs):
    rows = check_base(docs)
    out = [r for r in rows if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in out)
    assert sum(r["score"] for r in out) / tokens > sum(r["base_score"] for r in out) / tokens  # nearer to 0: likelier
    assert all(r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"])) for r in rows)


def test_odd_scores(spark, odd_docs, no_docs):
    check_base(odd_docs)
    assert brown.score(no_docs).count() == 0
    untaught = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"]) for r in brown.score(untaught).collect()) == [(1, 0, 0), (3, 0, 0)]


def own_classes(learned, start, number):
    """Class of each tail word by its own contexts, one word and class at a time."""
    first, around = Counter(), {}
    for tokens in learned:
        first.update((start(a), start(b)) for a, b in zip(tokens, tokens[1:], strict=False))
        for a, w, b in zip(tokens, tokens[1:], tokens[2:], strict=False):
            if w != " " and w not in number:
                around.setdefault(w, []).append((start(a), start(b)))
    out, into = Counter(), Counter()
    for (a, b), n in first.items():
        out[a] += n
        into[b] += n
    half = 0.5 * brown.KINDS
    gain = lambda a, c, b: round((math.log(first[a, c] + 0.5) + math.log(first[c, b] + 0.5) - math.log(out[c] + half) - math.log(into[c] + half)) * 2**20)
    return {w: max(range(brown.CLASSES), key=lambda c: (sum(gain(a, c, b) for a, b in places), -c)) for w, places in around.items()}


@pytest.mark.parametrize("limits", [{}, {"FREQUENT": 2, "SETTLED": 3, "ADDED": 2}])
def test_scores_are_those_of_the_class_model(spark, monkeypatch, limits):
    """Counts, transitions and emissions made anew from the texts and the words' classes; probabilities of what may follow add up to one."""
    monkeypatch.setattr(brown, "HEAD_SHARE", 0.004)
    for name, value in limits.items():
        monkeypatch.setattr(brown, name, value)
    rng = random.Random(12)
    words = [f"{a}{b}{c}" for a in "abcd" for b in "xyz" for c in ("ing", "ed", "s", "ly")]
    rows = [(i, " ".join(rng.choice(words[k % 7 :: 7]) if rng.random() < 0.97 else f"odd{rng.randrange(40)}" for k in range(rng.randrange(0, 40)))) for i in range(120)]
    rows = [(i, t + " never seen" * 2 * held(i, 5, 1)) for i, t in rows]  # what held-out texts are full of
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = brown.train(docs)
    got = {r["doc_id"]: r for r in brown.score(docs).collect()}
    model.lexicon.prepare()
    learned = [[" ", *words_of(t), " "] for i, t in rows if not held(i, 5, 1)]
    start = lambda w: int(model.classes[model.lexicon.end if w == " " else model.lexicon.number[w] if w in model.lexicon.number else model.lexicon.end + 1 + brown.tail_group(w[-3:])])
    kinds = own_classes(learned, start, model.lexicon.number)
    assert any(kinds[w] != start(w) for w in kinds)
    kind = lambda w: kinds.get(w, start(w))
    count, pairs = Counter(), Counter()
    for i, t in rows:
        if not held(i, 5, 1):
            tokens = [" ", *words_of(t), " "]
            count.update(tokens[1:])
            pairs.update((kind(a), kind(b)) for a, b in zip(tokens, tokens[1:], strict=False))
    assert len(model.lexicon.words) < len(count) - 1  # there is a tail
    assert ("never" in model.lexicon.apart) == bool(limits)
    k = brown.KINDS
    into = [sum(n for (_, b), n in pairs.items() if b == c) for c in range(k)]
    out = [sum(n for (a, _), n in pairs.items() if a == c) for c in range(k)]
    total = sum(into)
    size, distinct = Counter(), Counter()
    for w, n in count.items():
        size[kind(w)] += n
        distinct[kind(w)] += 1

    def follows(a, c):
        return (pairs[a, c] + brown.LEAN * (into[c] + 0.5) / (total + 0.5 * k)) / (out[a] + brown.LEAN)

    def emitted(w):
        return (count[w] + 0.5) / (size[kind(w)] + 0.5 * (distinct[kind(w)] + 1))

    for i, t in rows:
        tokens = [" ", *words_of(t), " "]
        want = sum(math.log10(follows(kind(a), kind(b)) * emitted(b)) for a, b in zip(tokens, tokens[1:], strict=False))
        assert got[i]["score"] == pytest.approx(want, abs=1e-6)
    for a in range(k):
        rest = {c: 0.5 / (size[c] + 0.5 * (distinct[c] + 1)) for c in range(k)}
        assert sum(follows(a, c) * (sum(emitted(w) for w in count if kind(w) == c) + rest[c]) for c in range(k)) == pytest.approx(1.0)


def shuffled_rows(spark, since=-1):
    """Rows that stages of a number above since wrote to shuffles, and the last stage's number."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    own = [x for x in (stages.apply(i) for i in range(stages.size())) if x.stageId() > since]
    return sum(x.shuffleWriteRecords() for x in own), max((x.stageId() for x in own), default=since)


def test_tail_words_shuffle_by_slice_not_by_text(spark, monkeypatch):
    """Tail words that most texts hold: fewer rows shuffle than texts hold of them, as a slice sends each word once, packed with those of its bucket."""
    monkeypatch.setattr(brown, "HEAD_SHARE", 0.004)
    monkeypatch.setattr(brown, "ROUNDS", 1)
    rng = random.Random(5)
    tail = [f"t{i}" for i in range(1000)]
    texts = [rng.sample(tail, 500) for _ in range(400)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(2)
    since = shuffled_rows(spark)[1]
    model = brown.train(docs)
    trained, at = shuffled_rows(spark, since)
    rows = brown.score(docs).collect()
    scored, _ = shuffled_rows(spark, at)
    assert not model.lexicon.words and len(rows) == len(texts)
    assert all(r["n_known"] == r["n_tokens"] == 501 for r in rows)
    assert 0 < scored - trained < len(texts) * 500 / 10  # score() trains again


def test_exchange_rises_and_finds_the_classes(spark):
    """Words of a few hidden classes that follow each other in turn: each round kept is likelier, and words of one hidden class end together."""
    rng = random.Random(3)
    hidden = [[f"w{c}x{i}" for i in range(60)] for c in range(4)]  # more words than classes: a class a word would leave nothing to gain
    rows = [(i, " ".join(rng.choice(hidden[k % 4]) for k in range(40))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = brown.word_counts(docs).df
    plain = Counter(w for i, t in rows if not held(i, 5, 1) for w in [*words_of(t), " "])
    assert {r["word"]: r["n"] for r in counts.collect()} == plain
    lexicon = brown.Lexicon(sorted(w for w in plain if w != " "))
    bigrams = brown.bigram_counts(docs, lexicon)
    classes, m, history = brown.cluster(bigrams.df, lexicon, rounds=14)
    assert len(history) > 3 and all(a < b for a, b in zip(history, history[1:], strict=False))
    own = Counter((w[1], int(classes[i])) for i, w in enumerate(lexicon.words))
    by_hand = np.zeros((brown.KINDS, brown.KINDS))
    for r in bigrams.df.collect():
        by_hand[classes[r["pair"] // lexicon.size], classes[r["pair"] % lexicon.size]] += r["n"]
    assert (m == by_hand).all() and brown.likelihood(m) == pytest.approx(history[-1])
    assert sum(len({h for h, c in own if c == k}) == 1 for k in {c for _, c in own}) >= 0.8 * len({c for _, c in own})


def test_exchange_gain_is_the_likelihoods():
    rng = np.random.default_rng(4)
    k, n = brown.KINDS, 30
    classes = np.concatenate([rng.integers(0, 5, n), [brown.CLASSES]])
    pairs = rng.integers(0, 6, (n + 1, n + 1)).astype(float)

    def matrix(c):
        m = np.zeros((k, k))
        np.add.at(m, (c[:, None], c[None, :]), pairs)
        return m

    m = matrix(classes)
    for w in range(8):
        after, before = np.zeros(k), np.zeros(k)
        np.add.at(after, classes, pairs[w])
        np.add.at(before, classes, pairs[:, w])
        best, gain = brown.best_class(m, int(classes[w]), after, before, pairs[w, w])
        by_hand = []
        for c in range(brown.CLASSES):
            moved = classes.copy()
            moved[w] = c
            by_hand.append(brown.likelihood(matrix(moved)) - brown.likelihood(m))
        assert gain == pytest.approx(max(by_hand), abs=1e-6) and by_hand[best] == pytest.approx(gain, abs=1e-6)


# --- classifiers ----------------------------------------------------------------------


def test_language_of_held_out_documents(docs):
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = langid.predictions(docs).collect()
    out = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == held(r["doc_id"], 5, 0) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in out) >= 0.95 * len(out)


def test_language_ignores_everything_but_text(docs):
    from pyspark.sql import functions as F

    model = langid.fit(docs.filter(langid.in_training(F.col("doc_id"))))
    a = {r["doc_id"]: tuple(r) for r in langid.identify(docs, model).collect()}
    b = {r["doc_id"]: tuple(r) for r in langid.identify(docs.withColumns({"lang": F.lit("xx"), "source": F.lit("s")}), model).collect()}
    assert a == b


def test_prediction_is_kernel_ridge_regression():
    """The folded matrix against the kernels themselves: Nystroem landmarks, one language against the rest, all in plain sums."""
    rng = random.Random(5)
    texts, labels = [], []
    for lang, letters in (("aa", "abcde"), ("bb", "cdefg"), ("cc", "aegxy")):
        for _ in range(langid.LANDMARKS + 6):
            texts.append(" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(12)))
            labels.append(lang)
    grams = []
    for t in texts:
        row = np.zeros(1 << langid.BITS, np.uint8)
        langid.presence(t, row)
        grams.append(set(np.flatnonzero(row).tolist()))
        assert abs(len(grams[-1]) - len({t[i : i + n] for n in (1, 2, 3, 4) for i in range(len(t) - n + 1)})) <= 2  # but for collisions
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    marks = [i for lang in ("aa", "bb", "cc") for i in [k for k, x in enumerate(labels) if x == lang][: langid.LANDMARKS]]
    k = np.array([[kernel(a, grams[m]) for m in marks] for a in grams])
    y = np.array([[1.0 if x == lang else -1.0 for lang in ("aa", "bb", "cc")] for x in labels])
    share = np.array([1 / labels.count(x) for x in labels])
    left = sum(s * np.outer(r, r) for s, r in zip(share, k, strict=True)) + langid.RIDGE * k[marks] / len(marks)
    alpha = np.linalg.solve(left + 1e-8 * np.eye(len(marks)), sum(s * np.outer(r, v) for s, r, v in zip(share, k, y, strict=True)))
    model = langid.solve([np.array(sorted(g), np.int32) for g in grams], labels)
    got = np.array([model.weights[np.isin(model.columns, sorted(g))].sum(axis=0) / math.sqrt(len(g)) for g in grams])
    assert np.abs(got - k @ alpha).max() < 1e-3
    names, scores = model.predict(texts)
    f = langid.SHARPNESS * (k @ alpha)
    p = np.exp(f - f.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    assert names == [("aa", "bb", "cc")[i] for i in p.argmax(axis=1)] and scores == pytest.approx(p.max(axis=1), abs=5e-3)


def test_signs_are_no_letters():
    model = langid.Model(["en"], np.zeros(0, np.int64), np.zeros((0, 1), np.float32))
    assert model.predict(["½ ² ①", "_1_", "½a", "ß", "日"])[0] == ["und", "und", "en", "en", "en"]


def test_folded_weights_are_the_kernel_machine():
    texts = ["the cat sat on the mat", "the dog and the cat", "le chat et la souris", "la souris dans la maison"]
    rows = [np.zeros(1 << langid.BITS, np.uint8) for _ in texts]
    for t, r in zip(texts, rows, strict=True):
        langid.presence(t, r)
    x = [set(np.flatnonzero(r)) for r in rows]
    model = langid.solve([np.array(sorted(s), np.int32) for s in x], ["en", "en", "fr", "fr"])
    names, scores = model.predict(texts + ["the mat", "1234", None, ""])
    assert names == ["en", "en", "fr", "fr", "en", "und", "und", "und"] and (scores[5:] == 0).all()
    for n in (1, 2, 3, 4):  # presence of n-grams: as many places as n-grams, but for collisions
        grams = {t[i : i + n] for t in texts[:1] for i in range(len(t) - n + 1)}
        assert len(grams) <= len(x[0])


def test_odd_languages(odd_docs, no_docs):
    rows = langid.predictions(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (2, 3, 4, 7))
    kept = langid.known_language(odd_docs)
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({2, 3, 4, 7})
    assert langid.predictions(no_docs).count() == langid.known_language(no_docs).count() == 0


def test_scorer_is_the_network():
    net = toxicity.Network()
    texts = ["you are an idiot", "", None, "a", "one two three four five six", "Zwei wörter"]
    scores = net.folded().score(texts)
    for t, s in zip(texts, scores, strict=True):
        b = np.array([toxicity.buckets(w) for w in toxicity.tokens(t)])
        assert s == pytest.approx(1 / (1 + math.exp(-net.raw(b))), abs=1e-5)


def test_toxicity_of_held_out_documents(spark):
    rng = random.Random(6)
    clean = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(1500):
        words, toxic = [rng.choice(clean) for _ in range(rng.randrange(5, 60))], i % 5 == 0
        for _ in range(2 * toxic):
            words[rng.randrange(len(words))] = rng.choice(["idiot", "moron", "vermint" + rng.choice(clean)])
        rows.append((i, " ".join(words), ["en", "de", None][i % 3]))
        labels.append((i, int(toxic)))
    docs, truth = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.predictions(docs, truth).collect()
    out = [r for r in got if r["held_out"]]
    hit = sum(r["predicted"] and r["doc_id"] % 5 == 0 for r in out)
    assert all(r["held_out"] == held(r["doc_id"], 4, 2) and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert hit >= 0.9 * sum(r["doc_id"] % 5 == 0 for r in out) and hit >= 0.9 * sum(r["predicted"] for r in out)
    net = toxicity.fit(docs.join(truth, "doc_id"), 200)
    assert set(net.thresholds) == {"en", "de"}
    flags = toxicity.flagged(toxicity.score(docs, net).join(docs.select("doc_id", "lang"), "doc_id"), net)
    assert flags.filter("flagged").count() > 0


def test_gradient_steps_are_those_of_the_loss():
    """One Adagrad step on one text against numerical derivatives of the logistic loss, with steps too small to move a pool's place."""
    net = toxicity.Network(3)
    b = np.array([toxicity.buckets(w) for w in "some plain words that follow".split()])

    def loss():
        return math.log1p(math.exp(-net.raw(b)))  # label 1

    before, numeric = {k: v.copy() for k, v in net.filters.items()} | {"out": net.out.copy()}, {}
    net.filters, net.out = {k: v.astype(np.float64) for k, v in net.filters.items()}, net.out.astype(np.float64)
    for k, v in [*net.filters.items(), ("out", net.out)]:
        g = np.zeros_like(v, np.float64)
        for at in np.ndindex(v.shape):
            old = v[at]
            v[at] = old + 1e-5
            up = loss()
            v[at] = old - 1e-5
            g[at] = (up - loss()) / 2e-5
            v[at] = old
        numeric[k] = g
    net.filters, net.out = {k: before[k].copy() for k in net.filters}, before["out"].copy()
    d = net.raw(b)
    net.train([b], np.array([1]), epochs=1)
    for k in numeric:
        step = (net.out if k == "out" else net.filters[k]) - before[k]
        big = np.abs(numeric[k]) > 1e-3
        assert (np.sign(step[big]) == -np.sign(numeric[k][big])).all() and big.any()
    assert net.raw(b) > d


def test_labels_that_differ_or_are_none(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, 0), (2, 0), (3, 7), (4, None), (None, 1), (5, -1), (5, 0)], "doc_id long, toxic int")
    assert sorted(map(tuple, toxicity.known_labels(labels).collect())) == [(1, 1), (2, 0), (5, 0)]


def test_thresholds_by_language(spark, monkeypatch):
    """Each language's cut parts its own cases best; the sample is bounded in bytes too."""
    s = np.array([0.9, 0.8, 0.6, 0.55, 0.2, 0.1])
    assert toxicity.best_cut(s, np.array([1, 1, 0, 0, 0, 0])) == pytest.approx(0.7)
    assert toxicity.best_cut(s, np.array([1, 1, 1, 1, 0, 0])) == pytest.approx(0.375)
    net = toxicity.Network()
    net.thresholds = {"en": 0.7, "de": 0.2}
    rows = spark.createDataFrame([("en", 0.6), ("en", 0.7), ("de", 0.25), ("fr", 0.29), (None, 0.31)], "lang string, score double")
    assert [r["flagged"] for r in toxicity.flagged(rows, net).collect()] == [False, True, True, False, True]
    from rankloom.llm.sampling import capped

    few = capped(spark.createDataFrame([(i, "x", bytes(10)) for i in range(50)], "doc_id long, label string, data binary"), "label", 20, "data", 75).collect()
    assert len(few) == 7


def test_long_text_shuts_out_no_other(spark):
    from pyspark.sql import functions as F

    from rankloom.llm.sampling import capped, position

    ids = spark.range(40).withColumn("place", position(F.col("id"))).orderBy("place").collect()
    rows = [(r["id"], "x", bytes(5000 if i == 0 else 10)) for i, r in enumerate(ids)] + [(100, "y", bytes(9000))]
    got = capped(spark.createDataFrame(rows, "doc_id long, label string, data binary"), "label", 30, "data", 1000).collect()
    assert sorted(r["doc_id"] for r in got) == sorted([r["id"] for r in ids[1:31]] + [100])  # the long one comes last, a label's only row stays


def test_odd_toxicity(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    some = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (5, None), (None, 1)], "doc_id long, toxic int").selectExpr("*", "1 AS text", "2 AS lang", "3 AS score")
    for labels in (none, some):
        rows = toxicity.predictions(odd_docs, labels).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.predictions(no_docs, some).count() == 0


@pytest.mark.parametrize("words", [40, 150, 900])
def test_recall_of_near_copies_at_several_edit_rates(spark, words):
    """Pairs planted at falling similarity, amid texts that share a passage with them: all at 0.8 or more link, against brute force."""
    rng = random.Random(words)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage, rows, number = [word() for _ in range(30)], [], iter(range(100_000))
    for share in (0.002, 0.005, 0.01, 0.015, 0.02, 0.03, 0.05):
        for _ in range(25):
            seed = [word() for _ in range(words)]
            other = list(seed)
            for k in rng.sample(range(words), max(1, round(words * share))):
                kind = rng.randrange(3)
                other[k] = "" if kind == 0 else word() if kind == 1 else other[k] + " " + word()
            rows += [(next(number), " ".join(passage + seed)), (next(number), " ".join(passage + other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in (words_of(t) for _, t in rows)]
    linked = {(u, v) for u, v in ((r["u"], r["v"]) for r in similar.similar_links(docs).collect())}
    wanted = [(i + 1, i) for i in range(0, len(rows), 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]
    assert len(wanted) >= 50 and set(wanted) == linked


def test_blocks_come_back_until_they_are_done(spark, monkeypatch):
    """Many unlike texts in one block, few partners a round: links hide behind partners that fail."""
    monkeypatch.setattr(similar, "FIRST", 1)
    monkeypatch.setattr(similar, "GROWTH", 2)
    monkeypatch.setattr(similar, "WHOLE_SLACK", 0.4)  # sketches that settle next to nothing
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base, rows = [word() for _ in range(60)], []
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(60), rng.randrange(0, 5)):
            w[k] = word()
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in similar.dedup(docs).collect()} == plain_groups(rows)


def test_ids_that_are_no_numbers_are_an_error(spark):
    with pytest.raises(TypeError, match="doc_id is string"):
        similar.dedup(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_sketches_pass_similar_sets_and_stop_unlike_ones():
    rng = np.random.default_rng(3)
    sets = []
    for n in (1, 4, 60, similar.SKETCH, 1000):
        base = rng.integers(1 << 63, size=n, dtype=np.uint64)
        for share in (1.0, 0.97, 0.93, 0.6, 0.3):
            kept = int(n * share)
            sets.append(np.unique(np.concatenate([base[:kept], rng.integers(1 << 63, size=n - kept, dtype=np.uint64)])))
    sizes = np.array([len(s) for s in sets])
    seen = similar.Sketches([similar.sketch_of(s) for s in sets], sizes)
    for i, s in enumerate(sets):
        got, sure = seen.alike(i, np.arange(len(sets)))
        for k, other in enumerate(sets):
            shared = len(np.intersect1d(s, other))
            true = shared / (len(s) + len(other) - shared)
            if true >= similar.SIMILARITY:
                assert got[k]
            if true < 0.5:
                assert not got[k]
            assert not sure[k] or true >= similar.SIMILARITY
        assert sure[i] or sizes[i] > similar.SKETCH
