"""A Merkle manifest of a dataset (operator 11): leaves, subroots by group, a root, and proofs.

Leaves are ordered by range partitions and indexed within their group.  Each
indexed partition streams its leaves over a mountain range: a stack of peaks,
on which a full family of siblings carries into its parent as digits carry in
a number of base ``fanout``.  Nodes are recorded as they complete; the peaks
that stay, those at the partition's unaligned edges, are merged by the same stack over
runs of neighbouring partitions, then of neighbouring runs, until one run is the
whole group; there short runs are closed without padding.  The subroots are the
leaves of a tree of their own, built by the same jobs.  So no task holds more
than a stack, and the number of rounds is a logarithm of the number of partitions.

Proofs: leaves are checked in aligned chunks.  A chunk computes the nodes inside
itself; what its paths need besides comes from the node records by a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Staged, prefix_sums, small_or_plain

FANOUT = 2
#: Leaves of a range partition, on average.
PART_ROWS = 200_000
#: Leaves of a chunk of proofs: the largest power of the fanout up to this.
CHUNK_ROWS = 4096
#: Neighbouring runs whose peaks one task merges.
MERGED = 64

Node = tuple[int, int, str]
NODES = "g string, part long, level int, idx long, digest string, peak boolean"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


# --- leaves --------------------------------------------------------------------


def field(c: Column) -> Column:
    """A value as text with its length in bytes before it; null is a dash."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)).cast("binary"), 256)


def group_key(c: Column) -> Column:
    """Text that is never null and sorts null first, then bytewise."""
    return F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), c.cast("string")))


# --- the mountain range --------------------------------------------------------


class MountainRange:
    """Peaks of a run of nodes of one tree, from left to right; ``made`` holds the nodes that completed."""

    def __init__(self, fanout: int):
        self.fanout, self.peaks, self.made = fanout, [], []

    def push(self, level: int, idx: int, own: str) -> None:
        """Add the next node; while its family is complete, the family makes way for its parent."""
        peaks, fanout = self.peaks, self.fanout
        peaks.append((level, idx, own))
        while idx % fanout == fanout - 1 and len(peaks) >= fanout and peaks[-fanout][:2] == (level, idx - fanout + 1):
            level, idx, own = self._fold(fanout)

    def _fold(self, n: int) -> Node:
        family = self.peaks[-n:]
        node = (family[0][0] + 1, family[0][1] // self.fanout, digest(*[x[2] for x in family]))
        self.peaks[-n:] = [node]
        self.made.append(node)
        return node

    def close(self) -> Node:
        """The top of a tree that ends here: last families of fewer nodes, even of one, are hashed as they are."""
        while len(self.peaks) > 1:
            level, idx, _ = self.peaks[-1]
            n = next((i for i, x in enumerate(reversed(self.peaks)) if (x[0], x[1] // self.fanout) != (level, idx // self.fanout)), len(self.peaks))
            top = self._fold(n)
            self.peaks.pop()
            self.push(*top)
        return self.peaks[0]


def _columns(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def _mountains(fanout: int) -> Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]]:
    """Node records and peaks of indexed partitions: rows g, part, idx, leaf in that order."""

    def run(batches):
        at, mountain, rows = None, None, []

        def peaks():
            return [(*at, *x, True) for x in mountain.peaks] if mountain else []

        for b in batches:
            for g, part, idx, own in zip(*[b.column(k).to_pylist() for k in ("g", "part", "idx", "leaf")], strict=True):
                if at != (g, part):
                    rows += peaks()
                    at, mountain = (g, part), MountainRange(fanout)
                mountain.push(0, idx, own)
                rows.append((g, part, 0, idx, own, False))
                if mountain.made:
                    rows += [(g, part, *x, False) for x in mountain.made]
                    mountain.made = []
            if len(rows) >= 4096:
                yield _columns(rows, NODES)
                rows = []
        rows += peaks()
        if rows:
            yield _columns(rows, NODES)

    return run


def _merge(fanout: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    """Nodes that complete where the peaks of neighbouring runs meet, and the peaks that stay; in the last round the tree's top."""

    def run(table):
        table = table.sort_by([("start", "ascending")])
        g, run_no = table.column("g")[0].as_py(), table.column("run")[0].as_py()
        mountain = MountainRange(fanout)
        for level, idx, own in zip(*[table.column(k).to_pylist() for k in ("level", "idx", "digest")], strict=True):
            mountain.push(level, idx, own)
        if last:
            mountain.close()
        rows = [(g, run_no, *x, False) for x in mountain.made] + [(g, run_no, *x, True) for x in mountain.peaks]
        return pa.Table.from_batches([_columns(rows, NODES)])

    return run


# --- the tree --------------------------------------------------------------------


@dataclass
class Tree:
    """One tree a group.

    leaves: g, part, idx, leaf and what came with them; spans: g, part, lo, hi
    (leaves lo to hi - 1 are the partition's); nodes: g, level, idx, digest of
    every node; tops: g, n, digest (n leaves); all are tables in the shared folder.
    """

    leaves: DataFrame
    spans: DataFrame
    nodes: DataFrame
    tops: DataFrame
    fanout: int


def build(rows: DataFrame, order: list[str], fanout: int = FANOUT, part_rows: int = PART_ROWS) -> Tree:
    """Trees of staged rows: g (never null), leaf and the order's columns; rows that tie in all of them are equal leaves, in any order.

    A group's leaves are spread by ranges of the order, and rows that tie by a
    row number, so that no group and no repeated row meets in one task.
    """
    spark = rows.sparkSession
    parts = max(1, -(-rows.count() // part_rows))
    numbered = Staged(rows.withColumn("tie", F.monotonically_increasing_id()), "leaves").df
    ranged = numbered.repartitionByRange(parts, "g", *order, "leaf", "tie").sortWithinPartitions("g", *order, "leaf", "tie")
    placed = Staged(ranged.withColumn("at", F.monotonically_increasing_id()), "leaves-placed").df  # partition and place in it
    placed = placed.withColumns({"part": F.shiftright("at", 33), "place": F.col("at").bitwiseAND((1 << 33) - 1)}).drop("at", "tie")
    counts = Staged(placed.groupBy("g", "part").agg(F.count("*").alias("n"), F.min("place").alias("first")), "leaf-counts").df
    spans = Staged(prefix_sums(counts, ["g"], "part", "n", "lo").withColumn("hi", F.col("lo") + F.col("n")), "leaf-spans").df
    n_spans = spans.count()
    own = small_or_plain(spans.select(F.col("g").alias("s_g"), F.col("part").alias("s_part"), "lo", "first"), n_spans, 64)
    leaves = placed.join(own, (F.col("g") == F.col("s_g")) & (F.col("part") == F.col("s_part"))).withColumn("idx", F.col("place") - F.col("first") + F.col("lo")).drop("s_g", "s_part", "lo", "first", "place")
    ordered = leaves.select("g", "part", "idx", "leaf").repartition(parts, "part").sortWithinPartitions("part", "g", "idx")
    made = [Staged(ordered.mapInArrow(_mountains(fanout), NODES), "nodes").df]
    width = MERGED
    while True:
        # start: the first leaf under a peak; where two peaks begin there would be two runs of one place, and there are none
        peaks = made[-1].filter("peak").withColumn("start", F.col("idx") * F.pow(F.lit(fanout), "level").cast("long"))
        last = width >= parts
        runs = peaks.withColumn("run", F.lit(0).cast("long") if last else F.floor(F.col("part") / MERGED))
        made.append(Staged(runs.groupBy("g", "run").applyInArrow(_merge(fanout, last), NODES), "nodes-merged").df)
        if last:
            break
        width *= MERGED
    sizes = spans.groupBy("g").agg(F.sum("n").alias("n"))
    tops = Staged(made[-1].filter("peak").select("g", "digest").join(sizes, "g"), "tops").df
    nodes = spark.createDataFrame([], NODES)
    for x in made:
        nodes = nodes.unionByName(x)
    return Tree(leaves, spans, nodes.filter("NOT peak").select("g", "level", "idx", "digest"), tops, fanout)


# --- proofs ----------------------------------------------------------------------


def _heights(n: int, fanout: int) -> list[int]:
    """Nodes of each level, from the leaves to the top."""
    found = [n]
    while found[-1] > 1:
        found.append(-(-found[-1] // fanout))
    return found


def _wanted(tree: Tree, chunk: int) -> DataFrame:
    """g, part, chunk, level, idx: siblings on the paths of a chunk's leaves that lie outside of it, in part or whole."""
    fanout = F.lit(tree.fanout)
    spans = tree.spans.join(tree.tops.select("g", F.col("n").alias("total")), "g")
    runs = spans.select("g", "part", "total", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / chunk), F.floor((F.col("hi") - 1) / chunk))).alias("chunk"))
    runs = runs.withColumns({"lo": F.greatest("lo", F.col("chunk") * chunk), "hi": F.least("hi", (F.col("chunk") + 1) * chunk)})
    levels = tree.nodes.groupBy("g").agg(F.max("level").alias("top"))
    each = runs.join(levels, "g").filter("top > 0").withColumn("level", F.explode(F.sequence(F.lit(0), F.col("top") - 1)))
    each = each.withColumn("size", F.pow(fanout, "level").cast("long")).withColumn("last", F.floor((F.col("total") - 1) / F.col("size")))
    family = F.array_distinct(F.array(*[F.floor(x / (F.col("size") * fanout)) for x in (F.col("lo"), F.col("hi") - 1)]))
    each = each.withColumn("family", F.explode(family))
    each = each.withColumn("idx", F.explode(F.sequence(F.col("family") * fanout, F.least(F.col("family") * fanout + fanout - 1, F.col("last")))))
    inside = (F.col("idx") * F.col("size") >= F.col("lo")) & (F.least((F.col("idx") + 1) * F.col("size"), "total") <= F.col("hi"))
    return each.filter(~inside).select("g", "part", "chunk", "level", "idx", F.col("total").alias("n"))


def proofs(tree: Tree, keep: list[str], fields: str, finish: Callable, extra: DataFrame | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``fields`` of every leaf, as ``finish`` makes them from its row and its path.

    finish(row, path, more): the leaf's columns ``keep`` and leaf; for each
    level the siblings before it and after it, joined; ``more``: (key, before,
    after) rows of its group in ``extra`` (g, key, before, after; few a group),
    by key.  It returns a tuple.
    """
    fanout, chunk = tree.fanout, tree.fanout
    while chunk * fanout <= chunk_rows:
        chunk *= fanout
    at = ["g", "part", "chunk"]
    leaves = tree.leaves.withColumn("chunk", F.floor(F.col("idx") / chunk)).join(F.broadcast(tree.tops.select("g", "n")) if tree.tops.count() <= 100_000 else tree.tops.select("g", "n"), "g")
    wanted = Staged(_wanted(tree, chunk), "wanted").df
    n_wanted = wanted.count()
    beside = tree.nodes.join(small_or_plain(wanted, n_wanted, 100), ["g", "level", "idx"]).select(*at, "level", "idx", F.col("digest").alias("before"), F.lit("").alias("after"))
    if extra is not None:
        chunks = leaves.select(*at).distinct()
        beside = beside.unionByName(chunks.join(extra, "g").select(*at, F.lit(-1).alias("level"), F.col("key").cast("long").alias("idx"), "before", "after"))

    def run(own: pa.Table, side: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.Table.from_batches([_columns([], fields)])
        known: dict[tuple[int, int], str] = {}
        more = []
        for level, idx, before, after in zip(*[side.column(k).to_pylist() for k in ("level", "idx", "before", "after")], strict=True):
            if level < 0:
                more.append((idx, before, after))
            else:
                known[level, idx] = before
        more.sort()
        index, found = own.column("idx").to_pylist(), own.column("leaf").to_pylist()
        known.update({(0, i): x for i, x in zip(index, found, strict=True)})
        heights = _heights(own.column("n")[0].as_py(), fanout)
        steps: list[dict[int, tuple[str, str]]] = []
        nodes = set(index)
        for level, n in enumerate(heights[:-1]):
            step, parents = {}, set()
            for i in nodes:
                first, end = i - i % fanout, min(i - i % fanout + fanout, n)
                family = [known[level, j] for j in range(first, end)]
                step[i] = ("".join(family[: i - first]), "".join(family[i - first + 1 :]))
                if i // fanout not in parents:
                    parents.add(i // fanout)
                    known[level + 1, i // fanout] = digest(*family)
            steps.append(step)
            nodes = parents
        rows = []
        for i, row in zip(index, own.select([*keep, "leaf"]).to_pylist(), strict=True):
            path = []
            for step in steps:
                path.append(step[i])
                i //= fanout
            rows.append(finish(row, path, more))
        return pa.Table.from_batches([_columns(rows, fields)])

    return leaves.select(*at, "idx", "n", "leaf", *keep).groupBy(*at).cogroup(beside.groupBy(*at)).applyInArrow(run, fields)


def fold(own: str, path: Iterable[tuple[str, str]]) -> str:
    """The root to which a leaf and the siblings of its path lead."""
    for before, after in path:
        own = digest(before, own, after)
    return own


# --- documents --------------------------------------------------------------------


@dataclass
class Manifest:
    """Trees of the documents of each lang, the tree of their subroots, the root, and each group's path to it (g, key, before, after)."""

    documents: Tree
    groups: Tree
    root: str
    upper: DataFrame


def manifest(docs: DataFrame, fanout: int = FANOUT, part_rows: int = PART_ROWS) -> Manifest | None:
    """Leaves of doc_id, source, lang, n_chars, text by lang and doc_id; None for a table without rows.

    Nulls have leaves of their own and sort first, a null lang is a group;
    repeated rows are leaves of their own, rows of one doc_id in the order of their leaves;
    other columns don't count.  Each leaf comes with ``forged``, the leaf of a
    row whose n_chars is one more, where 7 divides the crc32 of its doc_id (never
    for a null one).
    """
    columns = [F.col(k) for k in ("doc_id", "source", "lang", "n_chars", "text")]
    more = [(c + F.lit(1).cast("long")) if i == 3 else c for i, c in enumerate(columns)]
    forged = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, leaf(*more))
    rows = Staged(docs.select(group_key(F.col("lang")).alias("g"), "doc_id", leaf(*columns).alias("leaf"), forged.alias("forged")), "leaf-rows").df
    if rows.isEmpty():
        return None
    tree = build(rows, ["doc_id"], fanout, part_rows)
    subroots = tree.tops.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("digest").alias("leaf"))
    groups = build(subroots, ["name"], fanout, part_rows)
    root = groups.tops.first()["digest"]
    steps = proofs(groups, ["name"], "name string, steps string", lambda row, path, _: (row["name"], "|".join(f"{b},{a}" for b, a in path)))
    steps = Staged(steps, "group-paths").df
    each = steps.filter("steps != ''").select("name", F.posexplode(F.split("steps", r"\|")).alias("key", "step"))
    upper = each.select(F.col("name").alias("g"), F.col("key").cast("long").alias("key"), F.split_part("step", F.lit(","), F.lit(1)).alias("before"), F.split_part("step", F.lit(","), F.lit(2)).alias("after"))
    subroot = tree.tops.select("g", F.lit(-1).cast("long").alias("key"), F.col("digest").alias("before"), F.lit("").alias("after"))
    return Manifest(tree, groups, root, Staged(upper.unionByName(subroot), "group-steps").df)


VERIFIED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def verify(docs: DataFrame, fanout: int = FANOUT, part_rows: int = PART_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document, forged ones folded as forged.

    See :func:`manifest` for nulls, ties and repeated rows.
    """
    made = manifest(docs, fanout, part_rows)
    if made is None:
        return docs.sparkSession.createDataFrame([], VERIFIED)
    root = made.root

    def finish(row, path, more):
        subroot = more[0][1]  # its key comes before those of the steps
        whole = path + [x[1:] for x in more[1:]]
        own = row["leaf"]
        folded = fold(row["forged"] or own, whole)
        return row["doc_id"], own, subroot, root, digest(*[x for step in whole for x in step]), folded, folded == root

    return proofs(made.documents, ["doc_id", "forged"], VERIFIED, finish, made.upper, chunk_rows)


def oracle_sql() -> str:
    """The same for two children a node: levels by recursion, siblings by join, paths folded by recursion."""
    value = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    h = lambda n: f"sha256({' || '.join(map(value, ('doc_id', 'source', 'lang', n, 'text')))})"
    shifts = ", ".join(["-1"] * 8)
    crc = f"""xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), {shifts}]))),
      lambda acc, v: CASE WHEN v >= 0 THEN xor(acc, v) ELSE xor(acc >> 1, CASE WHEN acc & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END) END), CAST(4294967295 AS BIGINT))"""

    def levels(name: str, leaves: str) -> str:
        return f"""{name} AS (SELECT g, 0 AS level, idx, digest, n FROM {leaves}
  UNION ALL SELECT g, level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 1) // 2 FROM {name} WHERE n > 1 GROUP BY g, level, idx // 2)"""

    return f"""
WITH RECURSIVE rows AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS g, {h('n_chars')} AS leaf,
  CASE WHEN doc_id IS NOT NULL AND {crc} % 7 = 0 THEN {h('n_chars + 1')} END AS forged FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM rows),
low AS (SELECT g, idx, leaf AS digest, n FROM l),
{levels('nodes', 'low')},
tops AS (SELECT g, digest AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS gidx FROM nodes WHERE n = 1),
high AS (SELECT '' AS g, gidx AS idx, subroot AS digest, count(*) OVER () AS n FROM tops),
{levels('upper', 'high')},
every AS (SELECT 0 AS tree, g, level, idx, digest, n FROM nodes UNION ALL SELECT 1, g, level, idx, digest, n FROM upper),
walk AS (
  SELECT r, doc_id, leaf, t.subroot, t.gidx, 0 AS tree, l.g, 0 AS level, l.idx, l.n, coalesce(forged, leaf) AS folded, '' AS proof, false AS done FROM l JOIN tops t ON t.g = l.g
  UNION ALL
  SELECT r, doc_id, leaf, subroot, gidx,
    CASE WHEN w.n > 1 THEN w.tree ELSE 1 END, CASE WHEN w.n > 1 THEN w.g ELSE '' END, CASE WHEN w.n > 1 THEN w.level + 1 ELSE 0 END, CASE WHEN w.n > 1 THEN w.idx // 2 ELSE gidx END,
    CASE WHEN w.n > 1 THEN (w.n + 1) // 2 ELSE (SELECT count(*) FROM tops) END,
    CASE WHEN w.n = 1 THEN folded WHEN s.digest IS NULL THEN sha256(folded) WHEN w.idx % 2 = 0 THEN sha256(folded || s.digest) ELSE sha256(s.digest || folded) END,
    proof || CASE WHEN w.n > 1 THEN coalesce(s.digest, '') ELSE '' END, w.tree = 1 AND w.n = 1
  FROM walk w LEFT JOIN every s ON s.tree = w.tree AND s.g = w.g AND s.level = w.level AND s.idx = xor(w.idx, 1)
  WHERE NOT w.done)
SELECT doc_id, leaf, subroot, (SELECT digest FROM upper WHERE n = 1) AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = (SELECT digest FROM upper WHERE n = 1) AS verified
FROM walk WHERE done
"""
