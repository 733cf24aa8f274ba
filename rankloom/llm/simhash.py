"""SimHash near-duplicates with bit-sliced comparison (operator 7).

Fingerprints are compared only inside blocks that share a key: 64 bits fall
into five pieces, and two fingerprints that differ in at most two bits agree in
three of them at least, so ten keys of three pieces lose no link.  In a block
the fingerprints stand as vertical bit planes, 64 of them to a machine word:
one XOR of a plane with a query's bit updates 64 distances, which carry-save
counters hold as two bitwise planes and a sticky "over" plane.  Blocks whose
lanes are all over the radius are abandoned before the last plane.  Each block
yields a spanning forest of its links, never its pairs; components come from
alternating star contractions on tables.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Staged, ascii_lower, map_texts, words_of

RADIUS = 2
WORDS = 3  # of a shingle
SEED = 42
#: Width and shift of the five pieces of a fingerprint.
PIECES = [(13, 0), (13, 13), (13, 26), (13, 39), (12, 52)]
KEYS = list(itertools.combinations(range(len(PIECES)), len(PIECES) - RADIUS))
#: Larger blocks are searched breadth-first among the members not yet reached.
WHOLE_BLOCK = 512
LANES = 64
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# --- fingerprints -------------------------------------------------------------


def shingle_hashes(text: str | None) -> list[int]:
    """XXH64 of each shingle, repeats included; a text of fewer words is one shingle, no words none."""
    w = words_of(ascii_lower(text)) if text else []
    if len(w) < WORDS:
        return [xxhash.xxh64_intdigest(" ".join(w), SEED)] if w else []
    digest = xxhash.xxh64_intdigest
    return [digest(s, SEED) for s in map(" ".join, zip(w, w[1:], w[2:], strict=False))]


def fingerprints_of(texts: list[str | None]) -> np.ndarray:
    """64-bit fingerprints (uint64): a bit is 1 if set in over half of a text's hashes."""
    hashes = [shingle_hashes(t) for t in texts]
    n = np.fromiter(map(len, hashes), np.int64, len(hashes))
    out = np.zeros(len(texts), np.uint64)
    if not n.sum():
        return out
    flat = np.fromiter(itertools.chain.from_iterable(hashes), np.uint64, int(n.sum()))
    bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    full = np.flatnonzero(n)
    starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
    counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    out[full] = np.packbits(2 * counts > n[full, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long), a row a document."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())])
    return map_texts(docs.select("doc_id", "text"), lambda b: {"doc_id": b.column("doc_id"), "fp": fingerprints_of(b.column("text").to_pylist()).view(np.int64)}, schema, chars=4 << 20)


# --- bit-sliced comparison ------------------------------------------------------


def planes_of(lanes: np.ndarray) -> np.ndarray:
    """(blocks, 64) fingerprints -> (64 planes, blocks): bit i of plane b is bit b of lane i."""
    bits = np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8).reshape(-1, LANES, 8), axis=2, bitorder="little")
    packed = np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little"))
    return np.ascontiguousarray(packed.view(np.uint64)[:, :, 0].T)


def near(queries: np.ndarray, block: np.ndarray, planes: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """For each query and the block it asks: the mask of lanes within RADIUS (2) bits.

    ones and twos are the carry-save digits of 64 distances, over is sticky from
    a distance of four on; three shows as both digits set.
    """
    out = np.zeros(len(queries), np.uint64)
    at, q, k, v = np.arange(len(queries)), queries, block, valid[block]
    ones, twos, over = (np.zeros(len(q), np.uint64) for _ in range(3))
    for b in range(64):
        diff = planes[b, k] ^ (np.uint64(0) - ((q >> np.uint64(b)) & np.uint64(1)))
        carry = ones & diff
        ones ^= diff
        over |= twos & carry
        twos ^= carry
        if b % 8 == 7:
            alive = np.flatnonzero(~(over | (ones & twos)) & v)
            if len(alive) < len(q) * 0.7:  # abandon the rest: all of their lanes are past the radius
                at, q, k, v, ones, twos, over = (x[alive] for x in (at, q, k, v, ones, twos, over))
                if not len(q):
                    return out
    out[at] = ~(over | (ones & twos)) & v
    return out


def lanes_of(fps: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pad runs of the given sizes to whole blocks of 64: lanes, valid masks, blocks a run, first block of each run."""
    blocks = -(-sizes // LANES)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    run = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(fps)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    slot = first[run] * LANES + inside
    lanes, held = np.zeros(int(blocks.sum()) * LANES, np.uint64), np.zeros(int(blocks.sum()) * LANES, np.uint8)
    lanes[slot], held[slot] = fps, 1
    valid = np.packbits(held.reshape(-1, LANES), axis=1, bitorder="little").view(np.uint64)[:, 0]
    return lanes.reshape(-1, LANES), valid, blocks, first


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest index of each node's component, from links between indices."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def linked_runs(fps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For runs of fingerprints, end to end: index of the root that each is linked to inside its run."""
    roots, at, start = np.arange(len(fps)), 0, np.cumsum(sizes) - sizes
    small = np.flatnonzero((sizes > 1) & (sizes <= WHOLE_BLOCK))
    while at < len(small):  # a bounded number of (query, block) rows at once
        cost = np.cumsum(sizes[small[at:]] * -(-sizes[small[at:]] // LANES))
        some = small[at : at + max(1, int(np.searchsorted(cost, 200_000)))]
        at += len(some)
        n = sizes[some]
        which = np.repeat(start[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        lanes, valid, blocks, first = lanes_of(fps[which], n)
        run = np.repeat(np.arange(len(some)), n)
        asks = np.repeat(np.arange(len(which)), blocks[run])
        block = np.repeat(first[run], blocks[run]) + np.arange(len(asks)) - np.repeat(np.cumsum(blocks[run]) - blocks[run], blocks[run])
        mask = near(fps[which][asks], block, planes_of(lanes), valid)
        row, lane = np.nonzero(np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        other = (np.cumsum(n) - n)[run[asks[row]]] + (block[row] - first[run[asks[row]]]) * LANES + lane
        roots[which] = which[forest(asks[row], other, len(which))]
    for k in np.flatnonzero(sizes > WHOLE_BLOCK):
        roots[start[k] : start[k] + sizes[k]] = start[k] + linked_large(fps[start[k] : start[k] + sizes[k]])
    return roots


def linked_large(fps: np.ndarray) -> np.ndarray:
    """Roots of one large run: each member asks once, and only those not yet reached."""
    n = len(fps)
    root, left = np.full(n, -1), np.arange(n)
    for seed in range(n):
        if root[seed] >= 0:
            continue
        root[seed], front = seed, np.array([seed])
        left = left[root[left] < 0]
        while len(front) and len(left):
            lanes, valid, _, _ = lanes_of(fps[left], np.array([len(left)]))
            planes, reached = planes_of(lanes), np.zeros(len(valid), np.uint64)
            for part in np.array_split(front, -(-len(front) * len(valid) // 200_000) or 1):
                asks, block = np.repeat(fps[part], len(valid)), np.tile(np.arange(len(valid)), len(part))
                reached |= np.bitwise_or.reduce(near(asks, block, planes, valid).reshape(len(part), -1), axis=0)
            hit = np.flatnonzero(np.unpackbits(reached.view(np.uint8), bitorder="little")[: len(left)])
            front = left[hit]
            root[front] = seed
            left = np.delete(left, hit)
    return root


LINKS = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])
ARROW = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def link_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp), sorted by key, to links (fp, root of its block); a block may go on in the next batch."""

    def links(fp: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        roots = linked_runs(fp.view(np.uint64), sizes)
        moved = np.flatnonzero(roots != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[roots[moved]])], schema=ARROW)

    held_key, held = None, []
    for b in batches:
        key, fp = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp"))
        if not len(key):
            continue
        cut = np.flatnonzero(np.diff(key)) + 1
        if held_key is not None and key[0] == held_key:
            end = int(cut[0]) if len(cut) else len(key)
            held.append(fp[:end])
            key, fp, cut = key[end:], fp[end:], cut[1:] - end
            if not len(key):
                continue
        if held:
            whole = np.concatenate(held)
            yield links(whole, np.array([len(whole)]))
        last = int(cut[-1]) if len(cut) else 0
        if last:
            yield links(fp[:last], np.diff(np.concatenate([[0], cut])))
        held_key, held = key[-1], [fp[last:]]
    if held:
        whole = np.concatenate(held)
        yield links(whole, np.array([len(whole)]))


def block_keys(fp: Column) -> Column:
    """The ten keys of a fingerprint: which pieces, and a hash of what they hold."""
    piece = [F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1)) for width, shift in PIECES]

    def joined(number: int, kept: tuple[int, ...]) -> Column:
        key = F.lit(number).cast("long")
        for i in kept:
            key = F.shiftleft(key, PIECES[i][0]).bitwiseOR(piece[i])
        return key

    return F.array(*[joined(n, kept) for n, kept in enumerate(KEYS)])


def links(distinct: DataFrame) -> DataFrame:
    """Links u -> v between distinct fingerprints that span the same components as all pairs within the radius."""
    keyed = distinct.select("fp", F.explode(block_keys(F.col("fp"))).alias("key"))
    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(link_blocks, LINKS).distinct()


# --- components -----------------------------------------------------------------


def components(links: DataFrame) -> Staged:
    """Links (u, v) to stars (u, v): v is the smallest node of u's component; single nodes and roots have no row.

    Large and small star steps alternate until nothing moves; each round is
    written to the shared folder, so lineage stays short and nothing of it
    comes to the driver but one checksum.
    """

    def mark(t: Staged) -> tuple:
        row = t.df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        return tuple(row)

    now = Staged(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    seen = mark(now)
    while True:
        e = now.df
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        new = Staged(small, "stars")
        now.drop()
        now, was = new, seen
        seen = mark(now)
        if seen == was:
            return now


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: a row a document.

    component_id is the smallest doc_id that links of at most RADIUS bits reach.
    Texts without words (null, empty) have fingerprint zero and link like any
    other.  Rows that repeat, ids that are null included, stay as they are; a
    null id is no one's component_id unless its whole component has none.  An
    empty table gives no rows; other columns aren't read.
    """
    fps = Staged(fingerprints(docs), "fingerprints")
    distinct = Staged(fps.df.groupBy("fp").agg(F.min("doc_id").alias("lead")), "distinct")
    stars = components(links(distinct.df.select("fp")))
    rooted = distinct.df.join(stars.df.select(F.col("u").alias("fp"), "v"), "fp", "left").select("fp", "lead", F.coalesce("v", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("lead").alias("component_id"))
    of_print = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return fps.df.join(of_print, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
