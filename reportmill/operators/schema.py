"""A JSON Schema (draft 7) compiled once to an expression over variants that gives the errors of a value."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let

_NOTES = {"$schema", "$id", "title", "description", "default", "examples"}
_NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
_RULES = _NOTES | {"type", "enum", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "required", "properties", "additionalProperties", "items", "minItems", "maxItems"}


def _none() -> Column:
    return F.array().cast("array<string>")


def _number(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def _is(name: str, value: Column, kind: Column) -> Column:
    """Whether a value is of a schema's type: a number without a fraction is an integer, however it is written."""
    if name == "integer":
        return (kind == "BIGINT") | (kind.isin(*_NUMBERS) & (_number(value) % 1 == 0))
    return {"number": kind.isin(*_NUMBERS)}.get(name, kind == {"object": "OBJECT", "array": "ARRAY", "string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}.get(name, "?"))


def _equals(constant: Any, value: Column, kind: Column) -> Column:
    if constant is None:
        return kind == "VOID"
    if isinstance(constant, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == constant)
    if isinstance(constant, str):
        return (kind == "STRING") & (F.try_variant_get(value, "$", "string") == constant)
    if isinstance(constant, int | float):
        return kind.isin(*_NUMBERS) & (_number(value) == float(constant))
    raise ValueError(f"enum of {constant!r} is not supported")


def _member(value: Column, name: str) -> Column:
    if "'" in name or "\\" in name:
        raise ValueError(f"property {name!r} can't be looked up")
    return F.try_variant_get(value, f"$['{name}']", "variant")


def _if_there(schema: dict[str, Any], path: str) -> Callable[[Column], Column]:
    return lambda value: F.when(value.isNotNull(), _errors(schema, value, path)).otherwise(_none())


def _errors(schema: dict[str, Any], value: Column, path: str) -> Column:
    unknown = set(schema) - _RULES
    if unknown:
        raise ValueError(f"rules {sorted(unknown)} are not supported")
    at = path or "$"
    below = f"{path}." if path else ""
    kinds = [schema["type"]] if isinstance(schema.get("type"), str) else schema.get("type")

    def told(x: Column) -> Column:
        v, kind = x["v"], x["kind"]
        number, length = _number(v), F.length(F.try_variant_get(v, "$", "string"))
        of = lambda name, holds: F.when(holds, F.lit(f"{at}: {name}"))
        own, parts = [], []
        if kinds:
            held = _is(kinds[0], v, kind)
            for k in kinds[1:]:
                held = held | _is(k, v, kind)
            own.append(of("type", ~held))
        if "enum" in schema:
            same = F.lit(False)
            for constant in schema["enum"]:
                same = same | F.coalesce(_equals(constant, v, kind), F.lit(False))
            own.append(of("enum", ~same))
        for name, broken in (("minimum", lambda b: number < b), ("maximum", lambda b: number > b), ("exclusiveMinimum", lambda b: number <= b), ("exclusiveMaximum", lambda b: number >= b)):
            if name in schema:
                own.append(of(name, kind.isin(*_NUMBERS) & broken(float(schema[name]))))
        for name, broken in (("minLength", lambda b: length < b), ("maxLength", lambda b: length > b)):
            if name in schema:
                own.append(of(name, (kind == "STRING") & broken(schema[name])))
        own += [F.when((kind == "OBJECT") & _member(v, name).isNull(), F.lit(f"{below}{name}: required")) for name in schema.get("required", ())]
        known = schema.get("properties", {})
        for name, inner in known.items():
            parts.append(let(_member(v, name), _if_there(inner, f"{below}{name}")))
        if "items" in schema or "minItems" in schema or "maxItems" in schema:
            items = F.try_variant_get(v, "$", "array<variant>")
            if "items" in schema:
                parts.append(F.coalesce(F.flatten(F.transform(items, lambda i: _errors(schema["items"], i, f"{path}[]"))), _none()))
            for name, broken in (("minItems", lambda b: F.size(items) < b), ("maxItems", lambda b: F.size(items) > b)):
                if name in schema:
                    own.append(of(name, (kind == "ARRAY") & broken(schema[name])))
        more = schema.get("additionalProperties", True)
        if more is not True:
            others = F.filter(F.map_entries(F.when(kind == "OBJECT", F.try_variant_get(v, "$", "map<string,variant>"))), lambda e: ~e["key"].isin(*known) if known else F.lit(True))
            each = (lambda e: F.array(F.lit(f"{at}: additionalProperties"))) if more is False else (lambda e: _errors(more, e["value"], f"{below}*"))
            parts.append(F.coalesce(F.flatten(F.transform(others, each)), _none()))
        flat = F.array_compact(F.array(*own)) if own else _none()
        return F.concat(flat, *parts) if parts else flat

    kind = F.regexp_extract(F.coalesce(F.schema_of_variant(value), F.lit("VOID")), "^[A-Z]+", 0)
    return let(F.struct(value.alias("v"), kind.alias("kind")), told)


def compiled(schema: dict[str, Any]) -> Callable[[Column], Column]:
    """A function from a variant to its errors in sorted order: `path: rule` for each place where a rule is broken.

    Paths are written as in `list[].member`, with `*` for members that the schema doesn't name and $ for the value itself; every item and member
    adds errors of its own. A value that is missing breaks `required` alone, null is a value of type null. Of the draft's rules those of
    _RULES are known; others raise an error when the schema is compiled. A null variant (text that is no JSON) gives null.
    """
    return lambda value: F.when(value.isNotNull(), F.array_sort(_errors(schema, value, "")))
