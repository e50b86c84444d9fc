"""JSON Schema as Spark expressions: the first place at which a value breaks it.

``first_error`` turns a schema into one expression over a VARIANT. It knows
type (one or several), enum, const, anyOf, $ref into $defs, objects with
properties, required and additionalProperties, arrays with items, minItems and
maxItems, the bounds of numbers, and length and pattern of strings; titles,
descriptions and defaults say nothing about validity. A schema that refers to
itself is laid out ``DEPTH`` levels deep, and values that go deeper are errors.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.functions.text import bound, json_in_text

DEPTH = 6
KNOWN = {"type", "enum", "const", "anyOf", "$ref", "$defs", "properties", "required", "additionalProperties", "items", "minItems", "maxItems", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "pattern", "title", "description", "default", "examples", "format"}


def _kind(value: Column) -> Column:
    """The JSON type of a value; whole numbers are integers however they are written."""
    name = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    whole = F.when(number == F.floor(number), "integer").otherwise("number")
    return (
        F.when(F.is_variant_null(value), "null").when(F.startswith(name, F.lit("OBJECT")), "object").when(F.startswith(name, F.lit("ARRAY")), "array").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").otherwise(whole)
    )


def _said(x: Any) -> str:
    return json.dumps(x, ensure_ascii=False)


def _fits(value: Column, kind: Column, x: Any) -> Column:
    """Whether a value equals a constant that is no object or array."""
    if isinstance(x, bool):
        return (kind == "boolean") & (F.try_variant_get(value, "$", "boolean") == x)
    if isinstance(x, int | float):
        return kind.isin("integer", "number") & (F.try_variant_get(value, "$", "double") == float(x))
    if x is None:
        return kind == "null"
    if not isinstance(x, str):
        raise ValueError(f"constants are strings, numbers, booleans or null, not {x!r}")
    return (kind == "string") & (F.try_variant_get(value, "$", "string") == x)


def _checks(value: Column, kind: Column, path: Column, schema: dict, defs: dict, depth: int) -> list[Column]:
    """Errors of one value against one schema, in the order in which they count; each is null where there is none."""
    wrong = lambda holds, text: F.when(~holds, F.concat(path, F.lit(f": {text}")))
    found: list[Column] = []
    if unknown := set(schema) - KNOWN:
        raise ValueError(f"schema words that are not known: {sorted(unknown)}")
    if "$ref" in schema:
        if depth <= 0:
            return [F.concat(path, F.lit(": too deep"))]
        found += _checks(value, kind, path, defs[schema["$ref"].removeprefix("#/$defs/")], defs, depth - 1)
    if "type" in schema:
        types = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        allowed = [*types, "integer"] if "number" in types else types
        found.append(wrong(kind.isin(*allowed), f"not {' or '.join(types)}"))
    if "enum" in schema:
        found.append(wrong(reduce(lambda a, b: a | b, (_fits(value, kind, x) for x in schema["enum"])), f"not one of {_said(schema['enum'])}"))
    if "const" in schema:
        found.append(wrong(_fits(value, kind, schema["const"]), f"not {_said(schema['const'])}"))
    if "anyOf" in schema:
        options = [F.coalesce(*_checks(value, kind, path, s, defs, depth), F.lit("")) for s in schema["anyOf"]]
        found.append(wrong(reduce(lambda a, b: a | b, (o == "" for o in options)), "none of the options"))
    number = F.try_variant_get(value, "$", "double")
    for word, holds, text in (("minimum", lambda b: number >= b, "under"), ("maximum", lambda b: number <= b, "over"), ("exclusiveMinimum", lambda b: number > b, "not over"), ("exclusiveMaximum", lambda b: number < b, "not under")):
        if word in schema:
            found.append(wrong(~kind.isin("integer", "number") | holds(float(schema[word])), f"{text} {schema[word]}"))
    string = F.try_variant_get(value, "$", "string")
    for word, holds, text in (("minLength", lambda b: F.length(string) >= b, "shorter than"), ("maxLength", lambda b: F.length(string) <= b, "longer than"), ("pattern", lambda b: string.rlike(b), "without")):
        if word in schema:
            found.append(wrong((kind != "string") | holds(schema[word]), f"{text} {schema[word]}"))
    items = F.try_variant_get(value, "$", "array<variant>")
    for word, holds, text in (("minItems", lambda b: F.size(items) >= b, "fewer than"), ("maxItems", lambda b: F.size(items) <= b, "more than")):
        if word in schema:
            found.append(wrong((kind != "array") | holds(schema[word]), f"{text} {schema[word]}"))
    if "items" in schema:
        each = F.transform(items, lambda x, i: _error(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), schema["items"], defs, depth))
        found.append(F.when(kind == "array", F.get(F.array_compact(each), F.lit(0))))
    if "properties" in schema or "required" in schema or "additionalProperties" in schema:
        found.append(F.when(kind == "object", bound(F.try_variant_get(value, "$", "map<string,variant>"), lambda m: F.coalesce(*_fields(m, path, schema, defs, depth), F.lit(None).cast("string")))))
    return found


def _fields(m: Column, path: Column, schema: dict, defs: dict, depth: int) -> list[Column]:
    """Errors of an object: what is missing, then its fields in the order of the schema, then fields that it should not have."""
    known, found = schema.get("properties", {}), []
    for name in schema.get("required", ()):
        found.append(F.when(F.try_element_at(m, F.lit(name)).isNull(), F.concat(path, F.lit(f".{name}: missing"))))
    field = lambda name, inner: bound(F.try_element_at(m, F.lit(name)), lambda v: F.when(v.isNotNull(), _error(v, F.concat(path, F.lit(f".{name}")), inner, defs, depth)))
    found += [field(name, inner) for name, inner in known.items()]
    rest = schema.get("additionalProperties", True)
    others = F.array_sort(F.array_except(F.map_keys(m), F.array(*(F.lit(k) for k in known)).cast("array<string>")))
    if rest is False:
        found.append(F.when(F.size(others) > 0, F.concat(path, F.lit("."), F.get(others, F.lit(0)), F.lit(": not known"))))
    elif isinstance(rest, dict):
        each = F.transform(others, lambda k: _error(F.try_element_at(m, k), F.concat(path, F.lit("."), k), rest, defs, depth))
        found.append(F.get(F.array_compact(each), F.lit(0)))
    return found


def _error(value: Column, path: Column, schema: dict, defs: dict, depth: int) -> Column:
    return bound(_kind(value), lambda kind: F.coalesce(*_checks(value, kind, path, schema, defs, depth), F.lit(None).cast("string")))


def first_error(schema: dict, depth: int = DEPTH) -> Callable[[Column], Column]:
    """Column function: VARIANT to the path and kind of its first error, null where it is valid; a null VARIANT is '$: no JSON'."""
    defs = schema.get("$defs", {})
    return lambda value: bound(value, lambda v: F.when(v.isNull(), "$: no JSON").otherwise(_error(v, F.lit("$"), schema, defs, depth)))


def ddl(schema: dict, defs: dict | None = None, depth: int = DEPTH) -> str:
    """The Spark type of the values that a schema allows; variant, where they have no one type."""
    defs = schema.get("$defs", {}) if defs is None else defs
    if "$ref" in schema:
        return ddl(defs[schema["$ref"].removeprefix("#/$defs/")], defs, depth - 1) if depth > 0 else "variant"
    options = [s for s in schema.get("anyOf", ()) if s.get("type") != "null"]
    if len(options) == 1:
        return ddl(options[0], defs, depth)
    types = [t for t in ([schema.get("type")] if isinstance(schema.get("type"), str) else schema.get("type", ())) if t != "null"]
    if len(types) != 1:
        return "string" if schema.get("enum") and all(isinstance(x, str) for x in schema["enum"]) else "variant"
    if types[0] == "object":
        if not schema.get("properties"):
            return "map<string,variant>"
        return "struct<" + ",".join(f"`{k}`:{ddl(s, defs, depth)}" for k, s in schema["properties"].items()) + ">"
    if types[0] == "array":
        return f"array<{ddl(schema['items'], defs, depth) if 'items' in schema else 'variant'}>"
    return {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean"}[types[0]]


def validated(replies: DataFrame, column: str, schema: dict, value: str = "value", error: str = "error") -> DataFrame:
    """``replies`` with the typed value of the JSON in ``column`` and the first error; one of them is null.

    The JSON may stand in a fenced block or among other words. A valid value is
    read by the type of the schema, absent fields as null.
    """
    parsed = F.try_parse_json(json_in_text(F.col(column)))
    found = replies.withColumn(error, first_error(schema)(parsed))
    return found.withColumn(value, F.when(F.col(error).isNull(), F.try_variant_get(F.try_parse_json(json_in_text(F.col(column))), "$", ddl(schema))))
