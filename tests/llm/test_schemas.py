"""Patterns of schemas against the validator of tool calls, on random documents, whole and broken."""

import json
import random
import re

from rankloom.functions import schemas
from rankloom.llm import toolcalls


def value(draw, schema):
    """A random document of a schema, now and then of something near it."""
    if draw.random() < 0.06:
        return draw.choice([None, True, -1, 3, 0, "x", [], {}, 2.5])
    if "enum" in schema:
        return draw.choice(schema["enum"])
    kind = schema["type"]
    if kind == "object":
        own = {k: value(draw, v) for k, v in schema["properties"].items() if draw.random() > 0.03}
        return own | ({"more": 1} if draw.random() < 0.03 else {})
    if kind == "array":
        return [value(draw, schema["items"]) for _ in range(draw.choice([schema["minItems"], schema["minItems"], draw.randint(0, 4)]))]
    return {"string": "".join(draw.choices('ab"\\é{}[]\n ', k=draw.randint(0, 3))), "integer": draw.randint(-12, 130), "boolean": draw.random() < 0.5, "null": None, "number": draw.choice([0, 1.5, -2e9])}[kind]


def random_schema(draw, depth=0):
    kind = draw.choice(["object", "array", "string", "integer", "boolean", "null", "number", "enum"] if depth < 3 else ["string", "integer", "boolean"])
    if kind == "object":
        own = {f"k{i}": random_schema(draw, depth + 1) for i in range(draw.randint(1, 3))}
        return {"type": "object", "properties": own, "required": list(own), "additionalProperties": False}
    if kind == "array":
        least = draw.randint(0, 2)
        return {"type": "array", "items": random_schema(draw, depth + 1), "minItems": least, "maxItems": least + draw.randint(0, 2)}
    if kind == "integer":
        low = draw.randint(-15, 100)
        return {"type": "integer", "minimum": low, "maximum": low + draw.randint(0, 130)}
    return {"enum": ["a.b", 'c"d', 3, True]} if kind == "enum" else {"type": kind}


def lengths_fit(v, schema):
    """What the validator of tool calls leaves to others: the bounds of arrays."""
    if isinstance(v, list) and "items" in schema:
        return schema["minItems"] <= len(v) <= schema["maxItems"] and all(lengths_fit(x, schema["items"]) for x in v)
    return not isinstance(v, dict) or all(lengths_fit(x, schema["properties"][k]) for k, x in v.items() if k in schema.get("properties", {}))


def plain(schema):
    """The schema without the bounds that the validator refuses."""
    return {k: {n: plain(s) for n, s in v.items()} if k == "properties" else plain(v) if k == "items" else v for k, v in schema.items() if k not in ("minItems", "maxItems")}


def alike(v, schema):
    """JSON knows no 1 that is True, Python does; nor is 3.0 the text 3."""
    if "enum" in schema:
        return any(type(v) is type(x) and v == x for x in schema["enum"])
    if isinstance(v, list) and "items" in schema:
        return all(alike(x, schema["items"]) for x in v)
    return not isinstance(v, dict) or all(alike(x, schema["properties"][k]) for k, x in v.items() if k in schema.get("properties", {}))


def test_patterns_agree_with_the_validator():
    draw, right = random.Random(8), 0
    for _ in range(400):
        schema = random_schema(draw)
        p = re.compile(schemas.whole(schema).replace(r"\z", r"\Z"))
        for _ in range(6):
            v = value(draw, schema)
            good = toolcalls.fault(v, plain(schema)) is None and lengths_fit(v, schema) and alike(v, schema)
            for text in (json.dumps(v), json.dumps(v, indent=2, ensure_ascii=False), f" {json.dumps(v)}\n"):
                assert bool(p.search(text)) == good, (schema, text)
            assert not p.search(json.dumps(v) + "x")
            right += good
    assert 600 < right < 2400
