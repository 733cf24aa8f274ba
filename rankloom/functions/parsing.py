"""Model output to structures: the parts that regular expressions can't express."""

from __future__ import annotations

import json
import random
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The pattern of a fenced object, which decides what counts as one.
FENCED = re.compile(r"```(?:json)?\s*(\{.*?\})\s*```", re.S)
BRACE = re.compile(r"[{}]")


def balanced(text: str) -> str | None:
    """From the first brace to the one that closes it; braces inside strings count as well."""
    depth = first = 0
    for m in BRACE.finditer(text):
        if not depth:
            first = m.start()
            if m[0] == "}":
                continue  # a closing brace before any opening one
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return text[first : m.end()]
    return None


def json_object(text: str | None) -> dict | None:
    """The object in noisy text: a fenced one first, else the first balanced one; None if neither parses."""
    if text is None:
        return None
    candidates = [m[1] for m in [FENCED.search(text)] if m] + [b for b in [balanced(text)] if b]
    for c in candidates:
        try:
            return json.loads(c)
        except (ValueError, RecursionError):  # nested too deep is no object either
            pass
    return None


def json_text(value, **form) -> str | None:
    """JSON of a value; None for what JSON text can't hold: numbers that aren't finite, lone surrogates, nesting too deep."""
    try:
        text = json.dumps(value, ensure_ascii=False, allow_nan=False, **form)
        text.encode()
    except (ValueError, RecursionError):
        return None
    return text


def ranking_in(value: dict | None, k: int) -> list[int] | None:
    """The ranking of a parsed object, if it is a list of the integers 1..k, each once (booleans are none)."""
    r = value.get("ranking") if isinstance(value, dict) else None
    right = isinstance(r, list) and all(type(x) is int for x in r) and sorted(r) == list(range(1, k + 1))
    return r if right else None


@F.pandas_udf(T.StringType())
def parse_object(text: pd.Series) -> pd.Series:
    """Canonical text of the JSON object in noisy text, NULL if there is none or none that text can hold."""
    found = [json_object(t) for t in text]
    return pd.Series([None if x is None else json_text(x, sort_keys=True, separators=(",", ":")) for x in found], dtype=object)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def parse_ranking(text: pd.Series, k: pd.Series) -> pd.Series:
    """The ranking of k slots in noisy text; NULL without one, or without k."""
    return pd.Series([None if pd.isna(n) else ranking_in(json_object(t), int(n)) for t, n in zip(text, k, strict=True)], dtype=object)


@F.pandas_udf(T.BooleanType())
def is_json(text: pd.Series) -> pd.Series:
    """Strict JSON, nothing behind it."""
    return pd.Series([strict(t) for t in text], dtype=bool)


def strict(text: str | None) -> bool:
    try:
        json.loads(text)
    except (ValueError, TypeError, RecursionError):
        return False
    return True


def without_fence(text: str) -> str:
    """As :func:`text.strip_fence`, of one text."""
    bare = text.strip()
    if bare.startswith("```"):
        bare = bare.strip("`")
        bare = (bare[4:] if bare[:4].lower() == "json" else bare).strip()
    return bare


def bare_objects(text: pd.Series) -> pd.Series:
    """The strict JSON object that is all of a text, bare or in a fence; NULL without one."""
    bare = [without_fence(t) if t else "" for t in text]
    return pd.Series([t if t.startswith("{") and strict(t) else None for t in bare], dtype=object)


#: Kept where it stands: the optimizer neither repeats it at each use nor copies a filter on it to the other side of a join.
bare_object = F.pandas_udf(bare_objects, T.StringType()).asNondeterministic()


def model_output(text: Column, schema: str | T.StructType) -> Column:
    """A model's whole answer as a struct: one strict JSON object, bare or in a fence; NULL for anything else, with text before or behind it too.

    Worked out once a row, however often it is used; so it belongs in a select, not in a join's condition or an aggregate.
    """
    return F.from_json(bare_object(text), schema)


@F.pandas_udf(T.StringType())
def json_fault(text: pd.Series) -> pd.Series:
    """Why text isn't strict JSON; NULL if it is."""

    def why(t):
        try:
            json.loads(t)
        except json.JSONDecodeError as e:
            return e.msg
        except (ValueError, TypeError, RecursionError) as e:
            return type(e).__name__
        return None

    return pd.Series([why(t) for t in text], dtype=object)


@F.pandas_udf(T.StringType())
def pretty_json(text: pd.Series) -> pd.Series:
    """JSON with an indent of two, keys as they stand, no escapes beyond JSON's own; NULL for text that isn't JSON."""

    def indented(t):
        try:
            return None if t is None else json_text(json.loads(t), indent=2)
        except (ValueError, RecursionError):
            return None

    return pd.Series([indented(t) for t in text], dtype=object)


@F.pandas_udf(T.StringType())
def plain_json(text: pd.Series) -> pd.Series:
    """JSON on one line with a space behind commas and colons, keys as they stand; NULL for text that isn't JSON."""

    def spaced(t):
        try:
            return None if t is None else json_text(json.loads(t))
        except (ValueError, RecursionError):
            return None

    return pd.Series([spaced(t) for t in text], dtype=object)


def shuffled(items: list, seed: int, fixed_points: bool = True, tries: int = 200) -> list:
    """Another order of the items by a seeded draw: not the same one, or (fixed_points False) no value in its place.

    After the tries a swap of the first two, or a turn by one, stands in.
    """
    if len(items) < 2:
        return list(items)
    draw, out = random.Random(seed), list(items)
    for _ in range(tries):
        draw.shuffle(out)
        if out != items and (fixed_points or all(a != b for a, b in zip(out, items, strict=True))):
            return out
    return [items[1], items[0], *items[2:]] if fixed_points else [*items[1:], items[0]]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def shuffled_ranking(ranking: pd.Series, seed: pd.Series) -> pd.Series:
    """seed: hexadecimal text."""
    return pd.Series([None if r is None else shuffled([int(x) for x in r], int(s, 16)) for r, s in zip(ranking, seed, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def deranged(reasons: pd.Series, seed: pd.Series) -> pd.Series:
    return pd.Series([None if r is None else shuffled(list(r), int(s, 16), fixed_points=False) for r, s in zip(reasons, seed, strict=True)], dtype=object)
