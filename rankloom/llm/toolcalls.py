"""Chat formatting: tool-call linking (operator 2).

Calls and results meet in a hash join on (conversation, identifier).  Calls are
put in topological order of what they need: Kahn's algorithm gives each its
depth, from identifiers alone, many conversations to a task; conversations too
large for that go through rounds on tables, which carry open needs only.  Places
follow from (depth, turn) in ranges with prefix sums, so a huge conversation is
never one task.  Arguments are checked against the tool's schema and pairs are
serialised as canonical JSON: keys sorted, no spaces, no escapes but those that
JSON asks for.
"""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, Staged, map_texts, shared_path, small_or_plain, word_array

#: Turns of one range of a conversation.
RANGE = 1024
#: Calls of a conversation that one task may order.
KAHN_CALLS = 100_000
#: Levels of arrays and objects that arguments may have.
DEPTH = 100
SURROGATE = re.compile(r"\\u[dD][89a-fA-F]")

CALLS = "conv_id, turn, call_id, tool, arguments, needs"


# --- schemas and JSON -----------------------------------------------------------


TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "integer": int, "number": (int, float)}
#: What :func:`fault` checks, and what says nothing of values.
KEYWORDS = {"type", "required", "properties", "additionalProperties", "items", "enum", "minimum", "maximum", "minLength"}
REMARKS = {"title", "description", "default", "examples", "$schema", "$id"}


def refuse_unknown(schema: dict, at: str = "$") -> None:
    """An error for a schema with a keyword or a type that isn't checked, so that none is passed over in silence."""
    kinds = schema.get("type", [])
    unknown = sorted(set(schema) - KEYWORDS - REMARKS) + [k for k in ([kinds] if isinstance(kinds, str) else kinds) if k not in TYPES]
    if not isinstance(schema.get("additionalProperties", True), bool):
        unknown.append("additionalProperties with a schema")
    if unknown:
        raise ValueError(f"schema at {at}: {', '.join(unknown)} not supported")
    for k, own in schema.get("properties", {}).items():
        refuse_unknown(own, f"{at}.{k}")
    if "items" in schema:
        refuse_unknown(schema["items"], f"{at}[]")


def fault(value, schema: dict, at: str = "$") -> str | None:
    """The first way in which a JSON value breaks a schema of the keywords in KEYWORDS; ``type`` may be a list."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(isinstance(value, TYPES[k]) and not (k in ("integer", "number") and isinstance(value, bool)) for k in kinds):
        return f"{at}: not of type {' or '.join(kinds)}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not one of the allowed values"
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        return f"{at}: too short"
    if isinstance(value, (int, float)) and not isinstance(value, bool) and not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
        return f"{at}: out of range"
    if isinstance(value, dict):
        own = schema.get("properties", {})
        for k in schema.get("required", []):
            if k not in value:
                return f"{at}.{k}: missing"
        for k in sorted(value):
            if k in own:
                if found := fault(value[k], own[k], f"{at}.{k}"):
                    return found
            elif schema.get("additionalProperties", True) is False:
                return f"{at}.{k}: not known"
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            if found := fault(x, schema["items"], f"{at}[{i}]"):
                return found
    return None


def canonical(value) -> str:
    """Canonical JSON of a parsed value; whole floats are written as integers, NaN and infinities are errors."""

    def plain(x):
        if isinstance(x, float) and x.is_integer() and abs(x) < 2**53:
            return int(x)
        return {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else [plain(v) for v in x] if isinstance(x, list) else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def deeper(value, levels: int) -> bool:
    """Arrays and objects are nested in more than so many levels."""
    layer = [value]
    for _ in range(levels):
        layer = [x for v in layer if isinstance(v, dict | list) for x in (v.values() if isinstance(v, dict) else v)]
    return any(isinstance(x, dict | list) for x in layer)


def parsed(text: str | None):
    """(value, error) of strict JSON; duplicate keys, numbers that aren't finite, lone surrogates and more than DEPTH levels are errors."""

    def pairs(found):
        if len({k for k, _ in found}) < len(found):
            raise ValueError("duplicate key")
        return dict(found)

    def refuse(x):
        raise ValueError(x)

    def finite(x):
        return v if math.isfinite(v := float(x)) else refuse(x)

    if text is None:
        return None, "no arguments"
    try:
        value = json.loads(text, object_pairs_hook=pairs, parse_constant=refuse, parse_float=finite)
        if deeper(value, DEPTH):
            return None, "nested too deep"
        if SURROGATE.search(text):
            json.dumps(value, ensure_ascii=False).encode()
    except RecursionError:
        return None, "nested too deep"
    except ValueError:  # of JSON and of encoding
        return None, "not JSON"
    return value, None


# --- tables ---------------------------------------------------------------------


def turn_range(turn: Column) -> Column:
    return F.coalesce(F.floor(turn / RANGE), F.lit(-1))


def calls_in_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results written in messages (conv_id, turn, role, text) as JSON.

    An assistant's text {"tool_calls": [{"id", "name", "arguments", "needs"}]}
    holds calls, a tool's text {"tool_call_id", "content"} is a result; all
    other text, JSON or not, holds neither.
    """
    call = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,needs:array<string>>>>"
    calls = messages.filter("role = 'assistant'").select("conv_id", "turn", F.explode(F.from_json("text", call)["tool_calls"]).alias("c"))
    calls = calls.select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("tool"), "c.arguments", F.coalesce("c.needs", F.array().cast("array<string>")).alias("needs"))
    results = messages.filter("role = 'tool'").select("conv_id", "turn", F.from_json("text", "struct<tool_call_id:string,content:string>").alias("r"))
    return calls, results.select("conv_id", "turn", F.col("r.tool_call_id").alias("call_id"), F.col("r.content").alias("content")).filter("call_id IS NOT NULL")


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain conversations as calls and results.

    A user's turn calls "answer" with its text and number of words, a system
    turn calls "configure" with its text, an assistant's turn is the result of
    the last user turn before it.  Turns of another role, or of none, are
    neither.  Identifiers are conversation and turn.  A hash of the identifier,
    of 32, says what a call needs, since such turns don't: 0 the next user turn,
    which may need this one in turn, 1 to 7 nothing, else the user turn before.
    """
    c = conversations.select("conv_id", "turn", "role", "text").withColumn("range", turn_range(F.col("turn")))
    user = F.when(F.col("role") == "user", F.col("turn"))
    every = Window.partitionBy("conv_id").orderBy("range")
    # only ranges beside another one have something to carry: a small table, unless conversations are huge
    carried = c.groupBy("conv_id", "range").agg(F.max(user).alias("last"), F.min(user).alias("first"))
    carried = carried.withColumns({"before": F.max("last").over(every.rowsBetween(Window.unboundedPreceding, -1)), "after": F.min("first").over(every.rowsBetween(1, Window.unboundedFollowing))}).drop("last", "first")
    carried = Staged(carried.filter("before IS NOT NULL OR after IS NOT NULL").withColumnsRenamed({"conv_id": "k_conv", "range": "k_range"}), "carried").df
    carried = small_or_plain(carried, carried.count(), 40)
    within = Window.partitionBy("conv_id", "range").orderBy("turn")
    joined = c.join(carried, F.col("conv_id").eqNullSafe(F.col("k_conv")) & (F.col("range") == F.col("k_range")), "left")
    prior = F.coalesce(F.max(user).over(within.rangeBetween(Window.unboundedPreceding, -1)), F.col("before"))
    later = F.coalesce(F.min(user).over(within.rangeBetween(1, Window.unboundedFollowing)), F.col("after"))
    name = lambda turn: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.coalesce(turn.cast("string"), F.lit("null")))
    placed = joined.withColumns({"prior": prior, "later": later, "text": F.coalesce("text", F.lit(""))})
    spin = F.conv(F.substring(F.md5(name(F.col("turn")).cast("binary")), 1, 8), 16, 10).cast("long") % 32
    wanted = F.when(spin == 0, F.col("later")).when(spin >= 8, F.col("prior"))
    needs = F.when(wanted.isNotNull(), F.array(name(wanted))).otherwise(F.array().cast("array<string>"))
    arguments = F.when(F.col("role") == "user", F.to_json(F.struct(F.col("text").alias("prompt"), F.size(word_array(F.col("text"), SPACES)).alias("words")))).otherwise(F.to_json(F.struct(F.col("text").alias("prompt"))))
    calls = placed.filter("role IN ('user', 'system')").select("conv_id", "turn", name(F.col("turn")).alias("call_id"), F.when(F.col("role") == "user", "answer").otherwise("configure").alias("tool"), arguments.alias("arguments"), needs.alias("needs"))
    results = placed.filter("role = 'assistant'").select("conv_id", "turn", F.when(F.col("prior").isNotNull(), name(F.col("prior"))).otherwise(F.concat(F.lit("none:"), name(F.col("turn")))).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def every_call(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of :func:`turns_as_calls`, and those that messages hold as JSON."""
    plain, written = turns_as_calls(conversations), calls_in_messages(conversations)
    return tuple(a.unionByName(b) for a, b in zip(plain, written, strict=True))


#: Schemas of the tools of turns_as_calls.
TURN_SCHEMAS = {
    "answer": {"type": "object", "required": ["prompt", "words"], "properties": {"prompt": {"type": "string", "minLength": 1}, "words": {"type": "integer", "minimum": 1}}, "additionalProperties": False},
    "configure": {"type": "object", "required": ["prompt"], "properties": {"prompt": {"type": "string", "minLength": 1}}, "additionalProperties": False},
}


# --- order ----------------------------------------------------------------------


def kahn(calls: list[tuple[str, list[str]]]) -> dict[str, int]:
    """Depth of each call: one more than the deepest that it needs; calls on or behind a cycle have none."""
    need = {c: {x for x in needs} for c, needs in calls}
    behind, waits = defaultdict(list), {}
    for c, xs in need.items():
        known = [x for x in xs if x in need]
        waits[c] = len(known)
        for x in known:
            behind[x].append(c)
    depth = {c: 0 for c, n in waits.items() if not n}
    ready = list(depth)
    for c in ready:
        for d in behind[c]:
            waits[d] -= 1
            if not waits[d]:
                depth[d] = depth[c] + 1 if d not in depth else max(depth[d], depth[c] + 1)
                ready.append(d)
    for c in ready:  # the last to be counted down need not be the deepest
        depth[c] = max([0, *(depth[x] + 1 for x in need[c] if x in need)])
    return depth


def by_conversation(schema: pa.Schema):
    """A pass over rows (conv_id, call_id, needs), sorted by conversation, to depths; a conversation may go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, calls, out = None, None, ([], [], [])

        def settle():
            depth = kahn(list(calls.items()))
            out[0].extend([now] * len(calls))
            out[1].extend(calls)
            out[2].extend(map(depth.get, calls))

        def flush():
            full = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
            for c in out:
                c.clear()
            return full

        for b in batches:
            for conv, call, needs in zip(*(b.column(c).to_pylist() for c in ("conv_id", "call_id", "needs")), strict=True):
                if calls is None or conv != now:
                    if calls is not None:
                        settle()
                    now, calls = conv, {}
                calls.setdefault(call, []).extend(needs)
            if out[0]:
                yield flush()
        if calls is not None:
            settle()
            yield flush()

    return run


def depths(graph: DataFrame) -> DataFrame:
    """conv_id, call_id, depth of the calls (conv_id, call_id, needs), a row a conversation and identifier; null depth on or behind a cycle."""
    from pyspark.sql.pandas.types import to_arrow_schema

    known = F.array_compact(F.coalesce("needs", F.array().cast("array<string>")))  # a null need links to nothing
    graph = Staged(graph.withColumn("needs", known), "graph").df
    large = graph.groupBy("conv_id").agg(F.count("*").alias("n")).filter(F.col("n") > KAHN_CALLS).select(F.col("conv_id").alias("l_conv"))
    large = Staged(large, "large").df
    n_large = large.count()
    schema = T.StructType([graph.schema["conv_id"], T.StructField("call_id", T.StringType()), T.StructField("depth", T.IntegerType())])
    big = F.col("conv_id").eqNullSafe(F.col("l_conv"))
    rest = graph.join(small_or_plain(large, n_large, 16), big, "left_anti") if n_large else graph
    small = rest.repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(by_conversation(to_arrow_schema(schema, prefers_large_types=False)), schema)
    return small.unionByName(relaxed(graph.join(small_or_plain(large, n_large, 16), big, "left_semi"))) if n_large else small


def relaxed(graph: DataFrame) -> DataFrame:
    """As Kahn, in rounds on tables: each round settles the calls whose needs are all settled.

    Null identifiers match as values do.  A round reads and writes only the
    needs of calls that are still open; there are as many rounds as the longest
    chain of needs has calls.
    """
    key = lambda df: df.withColumnsRenamed({"conv_id": "k_conv", "call_id": "k_call", "depth": "d"})
    on = lambda call: F.col("conv_id").eqNullSafe(F.col("k_conv")) & F.col(call).eqNullSafe(F.col("k_call"))
    spark = graph.sparkSession
    nodes = Staged(graph.select("conv_id", "call_id").distinct(), "calls")
    edges = graph.select("conv_id", "call_id", F.explode("needs").alias("need")).distinct()
    edges = Staged(edges.join(key(nodes.df), on("need"), "left_semi").withColumn("known", F.lit(None).cast("int")), "needs")
    settled = shared_path(spark, "settled")
    front = Staged(nodes.df.join(key(edges.df.select("conv_id", "call_id").distinct()), on("call_id"), "left_anti").withColumn("depth", F.lit(0)), "front")
    front.df.write.mode("append").parquet(settled)
    while not front.df.isEmpty():
        # needs that this front settles get its depth; calls without an unsettled need are the next front
        met = edges.df.join(key(front.df), on("need"), "left").select("conv_id", "call_id", "need", F.coalesce("known", "d").alias("known"))
        met = Staged(met, "met")
        whole = met.df.groupBy("conv_id", "call_id").agg(F.max("known").alias("most"), F.count(F.when(F.col("known").isNull(), 1)).alias("open")).filter("open = 0")
        new = Staged(whole.select("conv_id", "call_id", (F.col("most") + 1).cast("int").alias("depth")), "front")
        new.df.write.mode("append").parquet(settled)
        left = Staged(met.df.join(key(new.df), on("call_id"), "left_anti"), "needs")
        for t in (edges, front, met):
            t.drop()
        edges, front = left, new
    done = spark.read.schema(front.schema).parquet(settled)
    return nodes.df.join(key(done), on("call_id"), "left").select("conv_id", "call_id", F.col("d").alias("depth"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """A row a call, and one a result without a call: conv_id, turn, call_id, tool, position, n_results, valid, error, canonical.

    calls: conv_id, turn, call_id, tool, arguments (JSON text), needs (array of
    call_id, of the same conversation; unknown ones are ignored).  results:
    conv_id, turn, call_id, content.  Of several results for a call the first by
    turn counts, n_results says how many there are.  position counts a
    conversation's calls from 0 in topological order: by depth (one more than the
    deepest call that it needs), then turn, call_id, tool and arguments; calls on
    or behind a cycle have none.  Calls that repeat stay, each linked.  Null
    conversations are one conversation, null identifiers link to nothing.  error
    names the first fault (JSON, tool, schema, cycle, no result, orphan result);
    valid is false for faults of the call itself.  Arguments that aren't strict
    JSON, or that no text can hold again, are an error, never a failure.  Empty
    tables give no rows.
    """
    for name, schema in schemas.items():
        refuse_unknown(schema, name)
    first = results.groupBy("conv_id", "call_id").agg(F.min_by("content", F.struct("turn", "content")).alias("result"), F.min("turn").alias("r_turn"), F.count("*").alias("n_results"))
    first = first.withColumnsRenamed({"conv_id": "r_conv", "call_id": "r_call"})
    staged = Staged(calls.select(*CALLS.split(", ")), "calls")
    c = staged.df
    deep = depths(c.select("conv_id", "call_id", "needs")).withColumnsRenamed({"conv_id": "d_conv", "call_id": "d_call"})
    c = c.join(deep, F.col("conv_id").eqNullSafe(F.col("d_conv")) & F.col("call_id").eqNullSafe(F.col("d_call")), "left").drop("d_conv", "d_call", "needs")
    c = Staged(c, "deep").df  # read twice below
    # rank by (depth, turn), in ranges: offset of the range and rank inside it
    c = c.withColumns({"range": turn_range(F.col("turn")), "open": F.col("depth").isNull()})
    place = ["conv_id", "open", "depth", "range"]
    before = Window.partitionBy("conv_id", "open").orderBy("depth", "range").rowsBetween(Window.unboundedPreceding, -1)
    offset = c.groupBy(*place).agg(F.count("*").alias("m")).withColumn("offset", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")
    offset = Staged(offset.filter("offset > 0").withColumnsRenamed({p: f"o_{p}" for p in place}), "offsets").df  # a conversation's first range has none
    offset = small_or_plain(offset, offset.count(), 48)
    within = Window.partitionBy(*place).orderBy("turn", "call_id", "tool", "arguments")
    same = F.lit(True)
    for p in place:
        same = same & F.col(p).eqNullSafe(F.col(f"o_{p}"))
    ranked = c.join(offset, same, "left").withColumn("position", F.when(~F.col("open"), F.coalesce("offset", F.lit(0)) + F.row_number().over(within) - 1))
    joined = ranked.join(first, F.col("conv_id").eqNullSafe(F.col("r_conv")) & (F.col("call_id") == F.col("r_call")), "left")
    joined = joined.select("conv_id", "turn", "call_id", "tool", "arguments", "position", "result", F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), F.lit(False).alias("orphan"))
    orphans = first.join(staged.df.select("conv_id", "call_id").distinct(), F.col("conv_id").eqNullSafe(F.col("r_conv")) & (F.col("call_id") == F.col("r_call")), "left_anti")
    null = lambda kind: F.lit(None).cast(kind)
    orphans = orphans.select(F.col("r_conv").alias("conv_id"), F.col("r_turn").alias("turn"), F.col("r_call").alias("call_id"), null("string").alias("tool"), null("string").alias("arguments"), null("long").alias("position"), "result", F.col("n_results").cast("long").alias("n_results"), F.lit(True).alias("orphan"))

    def of(b):
        valid, error, text = [], [], []
        for row in b.to_pylist():
            value, wrong = (None, None) if row["orphan"] else parsed(row["arguments"])
            if row["orphan"]:
                wrong = "orphan result"
            elif wrong is None and row["tool"] not in schemas:
                wrong = "unknown tool"
            elif wrong is None:
                wrong = fault(value, schemas[row["tool"]])
            if wrong is None and row["position"] is None:
                wrong = "cycle"
            valid.append(wrong is None)
            error.append(wrong or (None if row["n_results"] else "no result"))
            text.append(canonical({"arguments": value, "id": row["call_id"], "name": row["tool"], "result": row["result"]}))
        return {k: b.column(k) for k in ("conv_id", "turn", "call_id", "tool", "position", "n_results")} | {"valid": valid, "error": error, "canonical": text}

    out = T.StructType([*[joined.schema[k] for k in ("conv_id", "turn", "call_id", "tool", "position", "n_results")], T.StructField("valid", T.BooleanType()), T.StructField("error", T.StringType()), T.StructField("canonical", T.StringType())])
    return map_texts(joined.unionByName(orphans), of, out, text="arguments")


ORACLE_SQL = """
WITH RECURSIVE c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text,
             max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior,
             min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM conversations),
calls AS (SELECT *, conv_id || ':' || turn AS call_id, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words, CAST('0x' || md5(conv_id || ':' || turn)[1:8] AS BIGINT) % 32 AS spin,
             conv_id || ':' || CASE WHEN spin = 0 THEN later WHEN spin >= 8 THEN prior END AS need FROM c WHERE role IN ('user', 'system')),
deep(call_id, depth) AS (SELECT call_id, 0 FROM calls WHERE need IS NULL UNION SELECT calls.call_id, deep.depth + 1 FROM calls JOIN deep ON calls.need = deep.call_id),
placed AS (SELECT calls.*, depth, CASE WHEN depth IS NOT NULL THEN row_number() OVER (PARTITION BY conv_id, depth IS NULL ORDER BY depth, turn, calls.call_id, role DESC, text) - 1 END AS position FROM calls LEFT JOIN deep ON deep.call_id = calls.call_id),
res AS (SELECT conv_id, turn, CASE WHEN prior IS NULL THEN 'none:' || conv_id || ':' || turn ELSE conv_id || ':' || prior END AS call_id, text FROM c WHERE role = 'assistant'),
f AS (SELECT conv_id, call_id, arg_min(text, struct_pack(turn := turn, text := text)) AS result, min(turn) AS r_turn, count(*) AS n FROM res GROUP BY ALL)
SELECT c.conv_id, c.turn, c.call_id, CASE WHEN role = 'user' THEN 'answer' ELSE 'configure' END AS tool, position, coalesce(n, 0) AS n_results,
       text <> '' AND (role = 'system' OR words > 0) AND depth IS NOT NULL AS valid,
       CASE WHEN text = '' THEN '$.prompt: too short' WHEN role = 'user' AND words = 0 THEN '$.words: out of range' WHEN depth IS NULL THEN 'cycle' WHEN n IS NULL THEN 'no result' END AS error,
       '{"arguments":{"prompt":' || to_json(text) || CASE WHEN role = 'user' THEN ',"words":' || words ELSE '' END || '},"id":' || to_json(c.call_id)
         || ',"name":"' || CASE WHEN role = 'user' THEN 'answer' ELSE 'configure' END || '","result":' || CASE WHEN n IS NULL THEN 'null' ELSE CAST(to_json(result) AS VARCHAR) END || '}' AS canonical
FROM placed c LEFT JOIN f ON f.conv_id = c.conv_id AND f.call_id = c.call_id
UNION ALL
SELECT f.conv_id, r_turn, f.call_id, NULL, NULL, n, false, 'orphan result', '{"arguments":null,"id":' || to_json(f.call_id) || ',"name":null,"result":' || to_json(result) || '}'
FROM f WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = f.conv_id AND c.call_id = f.call_id)
"""
