"""Links between similar texts for the SimHash near-dedup stage (operator 7's wider use).

Two texts are similar if their sets of five-word shingles have a Jaccard
similarity of 0.8 or more.  Their 64-bit SimHashes then differ in ten bits on
average, far beyond what pieces of a fingerprint can find, so blocks come from
the shingle sets themselves: BANDS keys of ROWS smallest permuted hashes each,
of which a pair at 0.8 misses all in one case of 300,000.  Inside a block
fingerprints are compared bit-sliced, as in :mod:`simhash`, with five carry-save
digits.  What is within reach is then held against the texts' sketches, the
SKETCH smallest hashes of each set, which are the whole set for most texts and
settle such a pair; the others are verified on the shingle sets.

No block emits all its pairs.  In a round each member names a few partners, the
nearest that it isn't linked to yet, and eight times as many a round later;
links that hold merge.  A block is done once all its members are one group, or
none has more partners than it may name; only the others come back, so a round
after the first is small.  So each close pair is linked, tried, or inside one
component already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Staged, ascii_lower, fresh, map_texts, small_or_plain, words_of
from .simhash import components, forest, lanes_of, near_duplicates, planes_of

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
#: Bits that similar texts' fingerprints may differ in: over five deviations above the mean at 0.8.
WIDE = 26
#: Smallest hashes of a set that travel with it.
SKETCH = 192
#: How far from SIMILARITY an estimate may lie: for whole sets (32 bits of a hash may collide), and deviations for cut ones.
WHOLE_SLACK, DEVIATIONS = 0.02, 5.5
#: In larger blocks without links the first members ask for all.
WHOLE_BLOCK = 512
#: Partners that a member may name in the first round, and how many times more in each round after it.
FIRST, GROWTH = 4, 8
#: Rows of one partition of blocks.
PART_ROWS = 20_000
#: Links (16 bytes each) of which one task may find the components.
ONE_TASK = 500_000
#: (query, block) rows compared at once.
CHUNK = 8_000

MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(17)
#: Odd multipliers of the permutations, and of the places in a shingle.
TURNS = _rng.integers(1 << 31, size=BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
PLACES = _rng.integers(1 << 62, size=SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * MIX
    return x ^ (x >> np.uint64(29))


def shingle_set(words: list[str]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; fewer words than five are one shingle, none no shingle."""
    known: dict[str, int] = {}
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    if len(h) > SHINGLE:
        n = len(h) - SHINGLE + 1
        h = sum(h[i : i + n] * PLACES[i] for i in range(SHINGLE))
    elif len(h):
        h = (h * PLACES[: len(h)]).sum(keepdims=True)
    return np.unique(mixed(h))


def bands_of(s: np.ndarray) -> np.ndarray:
    """One key a band, from the smallest values of the band's permutations of the upper halves of the hashes."""
    upper = (mixed(s) >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(s), 2048):
        np.minimum(least, (upper[at : at + 2048][None, :] * TURNS[:, None]).min(axis=1), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = mixed(key * MIX + row)
    return key.view(np.int64)


def print_of(s: np.ndarray) -> int:
    """SimHash of a shingle set, as a signed long."""
    bits = np.unpackbits(s.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(s), bitorder="little").view(np.int64)[0])


def sketch_of(s: np.ndarray) -> bytes:
    """The upper halves of the SKETCH smallest hashes of a sorted set."""
    return (s[:SKETCH] >> np.uint64(32)).astype("<u4").tobytes()


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the words, fp, size of the shingle set, bands, sketch: rows with a doc_id and a word."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("digest", T.StringType()), T.StructField("fp", T.LongType()), T.StructField("size", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])

    def of(b):
        digest, fp, size, bands, sketch = [], [], [], [], []
        for t in b.column("text").to_pylist():
            w = words_of(ascii_lower(t)) if t else []
            s = shingle_set(w)
            digest.append(xxhash.xxh3_128_hexdigest(" ".join(w)) if w else None)
            fp.append(print_of(s) if w else 0)
            size.append(len(s))
            bands.append(bands_of(s) if w else None)
            sketch.append(sketch_of(s))
        return {"doc_id": b.column("doc_id"), "digest": digest, "fp": fp, "size": size, "bands": bands, "sketch": sketch}

    return map_texts(docs.select("doc_id", "text").filter("doc_id IS NOT NULL"), of, schema, chars=4 << 20).filter("digest IS NOT NULL")


# --- blocks -----------------------------------------------------------------------


def within(queries: np.ndarray, block: np.ndarray, planes: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Mask of lanes within WIDE (26) bits, for each query and the block it asks; five carry-save digits and a sticky one."""
    out = np.zeros(len(queries), np.uint64)
    at, q, k, v = np.arange(len(queries)), queries, block, valid[block]
    digits = [np.zeros(len(q), np.uint64) for _ in range(6)]

    def far():
        one, two, four, eight, sixteen, over = digits
        return over | (sixteen & eight & (four | (two & one)))

    for b in range(64):
        carry = planes[b, k] ^ (np.uint64(0) - ((q >> np.uint64(b)) & np.uint64(1)))
        for i in range(5):
            digits[i], carry = digits[i] ^ carry, digits[i] & carry
        digits[5] |= carry
        if b % 8 == 7 and b > WIDE:
            alive = np.flatnonzero(~far() & v)
            if len(alive) < len(q) * 0.7:  # abandon blocks whose lanes are all past the radius
                at, q, k, v = at[alive], q[alive], k[alive], v[alive]
                digits = [d[alive] for d in digits]
                if not len(q):
                    return out
    out[at] = ~far() & v
    return out


def close_pairs(asking: np.ndarray, fps: np.ndarray, planes: np.ndarray, valid: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of (asking index, lane) within WIDE bits."""
    step = max(1, CHUNK // len(valid))
    for lo in range(0, len(asking), step):
        some = asking[lo : lo + step]
        mask = within(np.repeat(fps[some], len(valid)), np.tile(np.arange(len(valid)), len(some)), planes, valid)
        row, lane = np.nonzero(np.unpackbits(mask.view(np.uint8).reshape(len(some), -1), axis=1, bitorder="little"))
        yield some[row], lane


class Sketches:
    """Sketches of a block's members, as ascending ranks of hashes in rows of equal length."""

    def __init__(self, sketches: list[bytes], sizes: np.ndarray):
        n = np.array([len(x) // 4 for x in sketches], np.int64)
        names, rank = np.unique(np.frombuffer(b"".join(sketches), "<u4"), return_inverse=True)
        self.end = len(names)  # fills rows up, and lies above each rank
        self.rows = np.full((len(n), max(1, n.max())), self.end, np.int32)
        self.rows[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = rank
        self.last = np.where(sizes > SKETCH, self.rows[np.arange(len(n)), n - 1], self.end - 1)
        self.whole = sizes <= SKETCH
        self.mark = np.zeros(self.end + 1, bool)

    def alike(self, who: int, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which lanes may be similar to a member, and which surely are: by the share that both have, of the hashes up to the smaller end of the two sketches."""
        own, rows = self.rows[who], self.rows[lanes]
        self.mark[own] = True
        self.mark[self.end] = False
        shared = self.mark[rows].sum(axis=1)
        self.mark[own] = False
        upto = np.minimum(self.last[who], self.last[lanes])
        union = np.searchsorted(own, upto, side="right") + (rows <= upto[:, None]).sum(axis=1) - shared
        whole = self.whole[who] & self.whole[lanes]
        slack = np.where(whole, WHOLE_SLACK, DEVIATIONS * np.sqrt(SIMILARITY * (1 - SIMILARITY) / np.maximum(union, 1)))
        return shared >= (SIMILARITY - slack) * union, whole & (shared >= (SIMILARITY + slack) * union)


def partners(ids: np.ndarray, fps: np.ndarray, roots: np.ndarray, sizes: np.ndarray, sketches: list[bytes], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Up to ``most`` partners a member: the nearest of other roots, alike by sketch.

    Larger ids, smaller ids, which pairs are surely similar, and whether some
    member has partners that it couldn't name.  sizes are of shingle sets.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), False
    if len(ids) < 2 or (roots == roots[0]).all():
        return none
    lanes, valid, _, _ = lanes_of(fps, np.array([len(fps)]))
    planes, found, n, seen, more = planes_of(lanes), [], len(ids), Sketches(sketches, sizes), False

    def fit(who, lane):
        low, high = np.minimum(sizes[who], sizes[lane]), np.maximum(sizes[who], sizes[lane])
        ok = (roots[who] != roots[lane]) & (low >= SIMILARITY * high)
        who, lane = who[ok], lane[ok]
        if not len(who):
            return who, lane, np.zeros(0, bool)
        cut = np.flatnonzero(np.diff(who, prepend=-1))
        pairs = [seen.alike(w, x) for w, x in zip(who[cut], np.split(lane, cut[1:]), strict=True)]
        ok, sure = (np.concatenate(x) for x in zip(*pairs, strict=True))
        return who[ok], lane[ok], sure[ok]

    names, held = np.unique(roots, return_counts=True)
    if held.max() == 1 and n > WHOLE_BLOCK and most == FIRST:
        left = np.ones(n, bool)
        for seed in range(n):  # stars about the first members not yet reached
            if left[seed]:
                left[seed] = False
                for who, lane in close_pairs(np.array([seed]), fps, planes, valid):
                    who, lane, sure = fit(who[left[lane]], lane[left[lane]])
                    found.append((who, lane, sure))
                    left[lane] = False
        more = True  # what a seed named isn't held against the others
    else:
        asking = np.flatnonzero(roots != names[held.argmax()]) if held.max() > 1 else np.arange(n)
        for who, lane in close_pairs(asking, fps, planes, valid):
            who, lane, sure = fit(who, lane)
            order = np.lexsort((lane, np.bitwise_count(fps[who] ^ fps[lane]), who))
            who, lane, sure = who[order], lane[order], sure[order]
            start = np.concatenate([[True], np.diff(who) != 0])[: len(who)]
            place = np.arange(len(who)) - np.maximum.accumulate(np.where(start, np.arange(len(who)), 0))
            few = place < most
            more |= not few.all()
            found.append((who[few], lane[few], sure[few]))
    who, lane, sure = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    # sure links go as stars of what they join, and no pair inside one is tried: rows that a block makes of them are fewer than its members
    star = forest(who[sure], lane[sure], n)
    moved = np.flatnonzero(star != np.arange(n))
    tried = np.flatnonzero(~sure & (star[who] != star[lane]))
    tried = tried[np.unique(np.minimum(who[tried], lane[tried]) * n + np.maximum(who[tried], lane[tried]), return_index=True)[1]]
    u, v = np.concatenate([moved, who[tried]]), np.concatenate([star[moved], lane[tried]])
    return np.maximum(ids[u], ids[v]), np.minimum(ids[u], ids[v]), np.arange(len(u)) < len(moved), more


EDGES = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])
ARROW = pa.schema([("u", pa.int64()), ("v", pa.int64())])


#: A link to be tried (or surely one), or the key of a block that must come back.
ASKED = T.StructType([*EDGES.fields, T.StructField("sure", T.BooleanType()), T.StructField("open", T.LongType())])
ASKED_ARROW = pa.schema([*ARROW, ("sure", pa.bool_()), ("open", pa.int64())])


def name_partners(most: int):
    """A pass over rows (key, id, fp, root, size, sketch), sorted by key and id, to ASKED; a block may go on in the next batch."""

    def links(key: int, rows: list[tuple]) -> pa.RecordBatch:
        ids, fps, roots, sizes = (np.concatenate([r[i] for r in rows]) for i in range(4))
        u, v, sure, more = partners(ids, fps.view(np.uint64), roots, sizes, [x for r in rows for x in r[4]], most)
        columns = [[*u.tolist(), *[None] * more], [*v.tolist(), *[None] * more], [*sure.tolist(), *[None] * more], [None] * len(u) + [int(key)] * more]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ASKED_ARROW, strict=True)], schema=ASKED_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []
        for b in batches:
            key, *columns = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "id", "fp", "root", "size"))
            columns.append(b.column("sketch").to_pylist())
            cut = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for lo, hi in zip(cut, cut[1:], strict=False):
                if lo == hi:
                    continue
                if held and key[lo] != held_key:
                    yield links(held_key, held)
                    held = []
                held_key = key[lo]
                held.append(tuple(c[lo:hi] for c in columns))
        if held:
            yield links(held_key, held)

    return run


# --- rounds -----------------------------------------------------------------------


def set_table(docs: DataFrame, ids: DataFrame, n_ids: int) -> DataFrame:
    """id and its shingle set, of the texts of some ids; rows of one id are one document."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("shingles", T.ArrayType(T.LongType()))])
    some = docs.select("doc_id", "text").join(small_or_plain(ids.withColumnRenamed("id", "doc_id"), n_ids, 16), "doc_id", "left_semi")
    sets = map_texts(some, lambda b: {"doc_id": b.column("doc_id"), "shingles": [shingle_set(words_of(ascii_lower(t or ""))).view(np.int64) for t in b.column("text").to_pylist()]}, schema, chars=4 << 20)
    return sets.groupBy(F.col("doc_id").alias("id")).agg(F.max_by("shingles", F.size("shingles")).alias("shingles"))


def similar_links(docs: DataFrame) -> DataFrame:
    """u > v: doc_ids that span the same components as all pairs of similar texts found; copies are linked to their smallest doc_id.

    Rows without a doc_id or without a word have no links; doc_id is a whole number.
    """
    table = Staged(prints(docs), "prints")
    classes = Staged(table.df.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    copies = table.df.select("doc_id", "digest").join(classes.df.select("digest", "id"), "digest").filter("doc_id <> id").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    copies = Staged(copies.distinct(), "copies")
    table.drop()
    # only members of blocks of two or more go on: most texts are like no other; of blocks with the same members one does
    keyed = classes.df.select("id", "fp", "size", F.xxhash64("digest").alias("text"), F.explode("bands").alias("key"))
    full = keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n"), F.bit_xor("text").alias("members")).filter("lo < hi")
    full = full.groupBy("lo", "hi", "n", "members").agg(F.min("key").alias("key")).select("key")
    keyed = Staged(keyed.drop("text").join(full, "key").dropDuplicates(["key", "id"]), "blocks")
    sketches = Staged(classes.df.groupBy("id").agg(F.max_by("sketch", "size").alias("sketch")).join(keyed.df.select("id").distinct(), "id", "left_semi"), "sketches")
    classes.drop()
    judged, open_keys, stars, most = [], None, None, FIRST
    while True:
        rows = keyed.df
        if open_keys is not None:
            rows = rows.join(small_or_plain(open_keys.df, open_keys.df.count(), 16), "key", "left_semi")
        if stars is None:
            rows = rows.withColumn("root", F.col("id"))
        else:
            rows = rows.join(stars.df.select(F.col("u").alias("id"), "v"), "id", "left").withColumn("root", F.coalesce("v", "id")).drop("v")
            apart = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
            rows = rows.join(apart, "key", "left_semi")
        rows = Staged(rows, "round")
        n_rows = rows.df.count()
        if n_rows:
            met = rows.df.join(sketches.df, "id").select("key", "id", "fp", "root", "size", "sketch")
            parts = 8 + min(n_rows // PART_ROWS, 100_000)
            asked = Staged(met.repartition(parts, "key").sortWithinPartitions("key", "id").mapInArrow(name_partners(most), ASKED).distinct(), "asked")
            pairs = asked.df.filter("open IS NULL AND NOT sure").select("u", "v")
            for before in judged:
                pairs = pairs.join(before.df.select("u", "v"), ["u", "v"], "left_anti")
            now = verified(docs, Staged(pairs, "pairs"))
            judged.append(now)
            new = asked.df.filter("sure").select("u", "v").unionByName(now.df.filter("similar").select("u", "v"))
            stars = grouped(new if stars is None else stars.df.unionByName(new))
            open_keys = Staged(asked.df.filter("open IS NOT NULL").select(F.col("open").alias("key")), "open")
            most *= GROWTH
            asked.drop()
        rows.drop()
        if not n_rows or open_keys.df.isEmpty():
            for t in (keyed, sketches, *judged):
                t.drop()
            return copies.df if stars is None else copies.df.unionByName(stars.df)


def verified(docs: DataFrame, pairs: Staged) -> Staged:
    """u, v, similar: the pairs, held to the shingle sets of their texts, which are made anew for those texts alone."""
    ids = Staged(pairs.df.select(F.col("u").alias("id")).unionByName(pairs.df.select(F.col("v").alias("id"))).distinct(), "ids")
    n_ids = ids.df.count()
    if not n_ids:
        return Staged(pairs.df.withColumn("similar", F.lit(True)), "judged")
    sets = Staged(set_table(docs, ids.df, n_ids), "sets")
    met = pairs.df.join(sets.df.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u").join(sets.df.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    out = Staged(met.select("u", "v", (shared >= SIMILARITY * (F.size("a") + F.size("b") - shared)).alias("similar")), "judged")
    for t in (sets, ids, pairs):
        t.drop()
    return out


def grouped(links: DataFrame) -> Staged:
    """As :func:`simhash.components`: stars (u, v) of links.  Up to ONE_TASK counted links are one task's work, more are contracted on tables."""
    table = Staged(links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")), "links")
    if table.df.count() > ONE_TASK:
        return components(table.df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [np.concatenate([b.column(c).to_numpy() for c in ("u", "v")]).reshape(2, -1) for b in batches if b.num_rows]
        if ends:
            names, place = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
            u, v = place.reshape(2, -1)
            root = names[forest(u, v, len(names))]
            moved = root != names
            yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(root[moved])], schema=ARROW)

    return Staged(table.df.coalesce(1).mapInArrow(run, EDGES), "stars")


def dedup(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, less all but one of each group of near-duplicates (that of the smallest doc_id).

    Texts link if their fingerprints (operator 7's: three words, two bits) do,
    or if they are similar (five words, 0.8); groups are what the links of both
    kinds reach.  Rows without a doc_id have no name to go by and stay; rows of
    one id are copies of one document, and one of them stays.  doc_id must be a
    whole number, other types are an error; other columns may have any name.  An
    empty table gives no rows.
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError(f"near-duplicates go by whole numbers; doc_id is {docs.schema['doc_id'].dataType.simpleString()}")
    found = Staged(near_duplicates(docs).select("doc_id", "component_id"), "components")
    close = found.df.filter("doc_id <> component_id").select(F.col("doc_id").alias("u"), F.col("component_id").alias("v"))
    gone = fresh(docs, "__lost")
    lost = Staged(grouped(close.unionByName(similar_links(docs))).df.select(F.col("u").alias(gone)).distinct(), "lost").df
    kept = docs.join(small_or_plain(lost, lost.count(), 16), docs["doc_id"] == F.col(gone), "left_anti")
    repeated = Staged(found.df.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "repeated").df
    n_repeated = repeated.count()
    if not n_repeated:
        return kept
    twice = fresh(docs, "__twice")
    ids = small_or_plain(repeated.withColumnRenamed("doc_id", twice), n_repeated, 16)
    single = kept.join(ids, F.col("doc_id") == F.col(twice), "left_anti")
    return single.unionByName(kept.join(ids, F.col("doc_id") == F.col(twice), "left_semi").dropDuplicates(["doc_id"]))
