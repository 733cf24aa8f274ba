"""A JSON schema as a regular expression, for constrained output and for a check inside the JVM.

Objects have their properties in the order of the schema, all of them; white
space may stand where JSON allows it.  What a pattern can't say (unknown
keywords, numbers with bounds that aren't whole, open objects) is an error.
"""

from __future__ import annotations

import json

SPACE = r"[ \t\n\r]*"
#: A character of a JSON string, as it may be written; and one that an enumeration's text may also be written as is left out.
CHARACTER = r'(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})'
INTEGER = r"-?(?:0|[1-9][0-9]*)"
NUMBER = INTEGER + r"(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"

KNOWN = {
    "object": {"type", "properties", "required", "additionalProperties"}, "array": {"type", "items", "minItems", "maxItems"}, "string": {"type", "minLength", "maxLength"},
    "integer": {"type", "minimum", "maximum"}, "number": {"type"}, "boolean": {"type"}, "null": {"type"},
}
REMARKS = {"title", "description", "default", "examples", "$schema", "$id"}


def literal(text: str) -> str:
    """A text that stands for itself, in Java's dialect and Python's."""
    return "".join(c if c.isalnum() or c in " _\"',:;<>=!@%&~`-/" else f"\\{c}" if c.isascii() and c.isprintable() else c for c in text)


def digits(low: str, high: str) -> list[str]:
    """Patterns of the numbers from low to high, both of one length."""
    if not low:
        return [""]
    if low == "0" * len(low) and high == "9" * len(high):
        return ["[0-9]" + (f"{{{len(low)}}}" if len(low) > 1 else "")]
    a, b, rest = low[0], high[0], len(low) - 1
    if a == b:
        return [a + p for p in digits(low[1:], high[1:])]
    found = []
    if rest and low[1:] != "0" * rest:
        found += [a + p for p in digits(low[1:], "9" * rest)]
        a = chr(ord(a) + 1)
    last = []
    if rest and high[1:] != "9" * rest:
        last = [b + p for p in digits("0" * rest, high[1:])]
        b = chr(ord(b) - 1)
    if a <= b:
        found.append((a if a == b else f"[{a}-{b}]") + "".join(digits("0" * rest, "9" * rest)))
    return found + last


def upto(low: int, high: int | None) -> list[str]:
    """Patterns of whole numbers of at least ``low`` (not below 0) and at most ``high``."""
    if high is None:
        n = len(str(low))
        return [*digits(str(low), "9" * n), f"[1-9][0-9]{{{n},}}"]
    found = []
    for n in range(len(str(low)), len(str(high)) + 1):
        least, most = max(low, 10 ** (n - 1) if n > 1 else 0), min(high, 10**n - 1)
        found += digits(str(least), str(most))
    return found


def integers(low: int | None, high: int | None) -> str:
    if low is None and high is None:
        return INTEGER
    if low is not None and high is not None and low > high:
        raise ValueError(f"no integer from {low} to {high}")
    parts = []
    if low is None or low < 0:  # from the number nearest to 0 on
        nearest = 1 if high is None or high >= 0 else -high
        parts += [f"-{p}" for p in upto(nearest, None if low is None else -low)]
    if high is None or high >= 0:
        parts += upto(max(low or 0, 0), high)
    return f"(?:{'|'.join(parts)})"


def repeated(item: str, low: int, high: int | None) -> str:
    """So many items with commas between them."""
    if high is not None and high < low:
        raise ValueError(f"no list of {low} to {high} items")
    if high == 0:
        return ""
    more = f"(?:{SPACE},{SPACE}{item}){{{max(low - 1, 0)},{'' if high is None else high - 1}}}"
    return f"{item}{more}" if low else f"(?:{item}{more})?"


def pattern(schema: dict, at: str = "$") -> str:
    """A pattern of the JSON texts of a schema, without white space around them."""
    if "enum" in schema:
        if set(schema) - {"enum", "type"} - REMARKS:
            raise ValueError(f"{at}: an enumeration with other keywords")
        return f"(?:{'|'.join(literal(json.dumps(x, ensure_ascii=False)) for x in schema['enum'])})"
    kind = schema.get("type")
    if isinstance(kind, list):
        return f"(?:{'|'.join(pattern({**{k: v for k, v in schema.items() if k in KNOWN[one]}, 'type': one}, at) for one in kind)})"
    if kind not in KNOWN or (unknown := set(schema) - KNOWN[kind] - REMARKS):
        raise ValueError(f"{at}: {kind if kind not in KNOWN else ', '.join(sorted(unknown))} not supported")
    if kind == "object":
        properties = schema.get("properties", {})
        if set(schema.get("required", properties)) != set(properties) or schema.get("additionalProperties", False):
            raise ValueError(f"{at}: properties that may be left out or added")
        own = [f'"{literal(k)}"{SPACE}:{SPACE}{pattern(v, f"{at}.{k}")}' for k, v in properties.items()]
        return rf"\{{{SPACE}" + f"{SPACE},{SPACE}".join(own) + rf"{SPACE}\}}" if own else rf"\{{{SPACE}\}}"
    if kind == "array":
        items = pattern(schema["items"], f"{at}[]") if "items" in schema else None
        if items is None:
            raise ValueError(f"{at}: items of any kind")
        return rf"\[{SPACE}{repeated(items, schema.get('minItems', 0), schema.get('maxItems'))}{SPACE}\]"
    if kind == "string":
        return f'"{CHARACTER}{{{schema.get("minLength", 0)},{schema.get("maxLength", "")}}}"'
    if kind == "integer":
        return integers(schema.get("minimum"), schema.get("maximum"))
    return {"number": NUMBER, "boolean": "(?:true|false)", "null": "null"}[kind]


def whole(schema: dict) -> str:
    """A pattern of whole texts: the schema's JSON with white space around it."""
    return rf"\A{SPACE}{pattern(schema)}{SPACE}\z"


def ranking_schema(k: int, reasons: bool = True) -> dict:
    """What a teacher's answer has to look like: persona, a reason a candidate, a ranking of k slots."""
    slot = {"type": "integer", "minimum": 1, "maximum": k}
    rationale = {"type": "object", "properties": {"candidate_index": slot, "reason": {"type": "string"}}}
    ranking = {"type": "array", "items": slot, "minItems": k, "maxItems": k}
    more = {"persona": {"type": "string"}, "rationales": {"type": "array", "items": rationale, "minItems": k, "maxItems": k}} if reasons else {}
    return {"type": "object", "properties": {**more, "ranking": ranking}}
