"""Schemas as expressions, against a plain validator."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from scholium.functions import schemas

FINDING = {"type": "object", "properties": {"claim": {"type": "string", "minLength": 2}, "strength": {"enum": ["strong", "weak", None]}, "score": {"type": "number", "minimum": 0, "exclusiveMaximum": 1}}, "required": ["claim"]}
SCHEMA = {
    "type": "object",
    "title": "Extraction",
    "properties": {
        "id": {"type": "integer", "minimum": 1, "maximum": 99},
        "tag": {"type": ["string", "null"], "pattern": "^[a-c]+$", "maxLength": 3},
        "kind": {"const": "paper"},
        "findings": {"type": "array", "items": {"$ref": "#/$defs/Finding"}, "minItems": 1, "maxItems": 2},
        "year": {"anyOf": [{"type": "integer"}, {"type": "null"}]},
        "more": {"type": "object", "additionalProperties": {"type": "boolean"}},
    },
    "required": ["id", "findings"],
    "additionalProperties": False,
    "$defs": {"Finding": FINDING},
}


def kind(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int | float):
        return "integer" if v == int(v) else "number"
    return {str: "string", list: "array", dict: "object"}[type(v)]


def plain(v, s, path="$"):
    """The first error, by the words of the schema in a fixed order."""
    k = kind(v)
    if "$ref" in s and (e := plain(v, SCHEMA["$defs"]["Finding"], path)):
        return e
    if "type" in s:
        types = [s["type"]] if isinstance(s["type"], str) else s["type"]
        if k not in types and not (k == "integer" and "number" in types):
            return f"{path}: not {' or '.join(types)}"
    same = lambda a, b: kind(a) == kind(b) and a == b
    if "enum" in s and not any(same(v, x) for x in s["enum"]):
        return f"{path}: not one of {json.dumps(s['enum'])}"
    if "const" in s and not same(v, s["const"]):
        return f"{path}: not {json.dumps(s['const'])}"
    if "anyOf" in s and all(plain(v, x, path) for x in s["anyOf"]):
        return f"{path}: none of the options"
    if k in ("integer", "number"):
        for word, bad, text in (("minimum", lambda b: v < b, "under"), ("maximum", lambda b: v > b, "over"), ("exclusiveMinimum", lambda b: v <= b, "not over"), ("exclusiveMaximum", lambda b: v >= b, "not under")):
            if word in s and bad(s[word]):
                return f"{path}: {text} {s[word]}"
    if k == "string":
        for word, bad, text in (("minLength", lambda b: len(v) < b, "shorter than"), ("maxLength", lambda b: len(v) > b, "longer than"), ("pattern", lambda b: not re.search(b, v), "without")):
            if word in s and bad(s[word]):
                return f"{path}: {text} {s[word]}"
    if k == "array":
        for word, bad, text in (("minItems", lambda b: len(v) < b, "fewer than"), ("maxItems", lambda b: len(v) > b, "more than")):
            if word in s and bad(s[word]):
                return f"{path}: {text} {s[word]}"
        for i, x in enumerate(v):
            if "items" in s and (e := plain(x, s["items"], f"{path}[{i}]")):
                return e
    if k == "object":
        for name in s.get("required", ()):
            if name not in v:
                return f"{path}.{name}: missing"
        for name, inner in s.get("properties", {}).items():
            if name in v and (e := plain(v[name], inner, f"{path}.{name}")):
                return e
        for name in sorted(set(v) - set(s.get("properties", {}))):
            rest = s.get("additionalProperties", True)
            if rest is False:
                return f"{path}.{name}: not known"
            if isinstance(rest, dict) and (e := plain(v[name], rest, f"{path}.{name}")):
                return e
    return None


def value(rnd):
    pick = lambda *x: rnd.choice(x)
    finding = lambda: pick(*[{"claim": pick("cc", "long", "x", 7), **({"strength": pick("strong", None, "mid", 1)} if rnd.random() < 0.5 else {}), **({"score": pick(0, 0.5, 1, -0.1, "0")} if rnd.random() < 0.5 else {})}] * 5, {}, "no")
    v = {"id": pick(*[5] * 6, 1.0, 2.5, 0, 100, "5", True, None), "findings": pick(*[[finding()]] * 5, [finding(), finding()], [], [finding()] * 3, {})}
    for name, made in (("tag", ("ab", None, "abcd", "x", 3)), ("kind", ("paper", "paper", "book")), ("year", (2000, None, "2000", 1.5)), ("more", ({}, {"a": True}, {"b": 1, "a": False}, [])), ("other", (1,))):
        if rnd.random() < (0.1 if name == "other" else 0.4):
            v[name] = pick(*made)
    if rnd.random() < 0.1:
        v.pop(pick("id", "findings"))
    return pick(*[v] * 30, [v], "text", 3, None)


def test_random_values_against_a_plain_validator(spark):
    rnd = random.Random(8)
    values = [value(rnd) for _ in range(800)]
    want = [plain(v, SCHEMA) for v in values]
    assert sum(w is None for w in want) > 10 and len(set(want)) > 25
    frame = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)], "k int, j string")
    got = [r.e for r in frame.select("k", schemas.first_error(SCHEMA)(F.try_parse_json("j")).alias("e")).orderBy("k").collect()]
    assert got == want


def test_valid_and_quarantined_replies(spark):
    rows = [('Here: ```json\n{"claim": "it holds", "score": 0.5}\n```',), ("no json",), (None,), ('{"claim": "x"}',), ("[1]",)]
    found = schemas.validated(spark.createDataFrame(rows, "reply string"), "reply", FINDING).collect()
    assert [r.error for r in found] == [None, "$: no JSON", "$: no JSON", "$.claim: shorter than 2", "$: not object"]
    assert found[0].value.asDict() == {"claim": "it holds", "strength": None, "score": 0.5} and found[3].value is None


def test_recursive_schema(spark):
    tree = {"$ref": "#/$defs/N", "$defs": {"N": {"type": "object", "properties": {"id": {"type": "string"}, "sub": {"type": "array", "items": {"$ref": "#/$defs/N"}}}, "required": ["id"]}}}
    rows = ['{"id": "1", "sub": [{"id": "1.1"}, {"id": 2}]}', '{"id": "1", "sub": [{"sub": []}]}', '{"id": "1", "sub": [{"id": "a", "sub": [{"id": "b", "sub": [{"id": "c"}]}]}]}']
    frame = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, j string")
    error = schemas.first_error(tree, depth=3)(F.try_parse_json("j"))
    assert [r[0] for r in frame.orderBy("k").select(error).collect()] == ["$.sub[1].id: not string", "$.sub[0].id: missing", "$.sub[0].sub[0].sub[0]: too deep"]


def test_unknown_words_are_refused():
    with pytest.raises(ValueError, match="not known"):
        schemas.first_error({"type": "object", "oneOf": []})(F.lit(None))
