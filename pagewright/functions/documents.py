"""Checks of JSON documents against a schema, as Spark expressions over variants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the type of a variant begins with, for each type of a schema.
_TYPES = {"object": "OBJECT", "array": "ARRAY", "string": "STRING", "integer": "BIGINT", "number": "BIGINT|DECIMAL|DOUBLE|FLOAT", "boolean": "BOOLEAN", "null": "VOID"}


def _pointer(path: Column, step: str | Column) -> Column:
    return F.concat(path, F.lit("/"), F.lit(step) if isinstance(step, str) else step)


def _given(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def violations(value: Column, schema: dict) -> Column:
    """Where a variant differs from a JSON Schema: an array of "path: keyword", empty for a valid document.

    type, const, pattern, required, properties, items and references into $defs are looked at. A null document isn't
    an object; an integer is a number without a fraction. A value, its entries and its type are worked out once for each
    place of the schema; objects and arrays are told by their entries, as the whole type of a document is as long as itself.
    """
    return _violations(value, schema, F.lit(""), schema)


def _violations(value: Column, schema: dict, path: Column, whole: dict, optional: bool = False) -> Column:
    """``violations`` of the value at ``path``; one that is ``optional`` and isn't there has none."""
    if "$ref" in schema:
        return _violations(value, whole["$defs"][schema["$ref"].rsplit("/", 1)[1]], path, whole, optional)
    types = [schema["type"]] if isinstance(schema.get("type"), str) else schema.get("type", [])
    parts = {}
    if "object" in types or "required" in schema or "properties" in schema:
        parts["own"] = "map<string,variant>"
    if "items" in schema:
        parts["items"] = "array<variant>"

    def found(x: Column) -> Column:
        if not parts:
            return _found(x, {}, schema, types, path, whole)
        return _given(F.struct(*(F.try_variant_get(x, "$", t).alias(name) for name, t in parts.items())), lambda has: _found(x, {name: has[name] for name in parts}, schema, types, path, whole))

    return _given(value, lambda x: F.when(x.isNull(), _none()).otherwise(found(x)) if optional else found(x))


def _none() -> Column:
    return F.array().cast("array<string>")


def _found(value: Column, has: dict[str, Column], schema: dict, types: list[str], path: Column, whole: dict) -> Column:
    """The violations of one value; ``has`` are its entries (own) and items, null where it is no object or array."""
    wrong = lambda ok, word: F.when(ok, _none()).otherwise(F.array(F.concat(path, F.lit(f": {word}"))))
    found = []
    if types:
        kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
        ok = kind.rlike("^(" + "|".join(_TYPES[t] for t in types) + ")") if len(types) > 1 or "|" in _TYPES[types[0]] else kind.startswith(_TYPES[types[0]])
        if "object" in types:
            ok = F.when(has["own"].isNotNull(), True).otherwise(ok)
        if "array" in types:  # an item tells it; an array without any is short
            ok = F.when((has["items"] if "items" in has else F.try_variant_get(value, "$[0]", "variant")).isNotNull(), True).otherwise(ok)
        found.append(wrong(ok, "type"))
    if "const" in schema:
        found.append(wrong(F.coalesce(F.try_variant_get(value, "$", "string") == F.lit(schema["const"]), F.lit(False)), "const"))
    if "pattern" in schema:
        found.append(wrong(F.coalesce(F.try_variant_get(value, "$", "string").rlike(schema["pattern"]), F.lit(False)), "pattern"))
    if schema.get("required") or schema.get("properties"):
        each = [_violations(F.try_element_at(has["own"], F.lit(key)), part, _pointer(path, key), whole, optional=True) for key, part in schema.get("properties", {}).items()]
        if listed := schema.get("required"):
            missing = F.filter(F.array(*map(F.lit, listed)), lambda key: F.try_element_at(has["own"], key).isNull())
            each.insert(0, F.transform(missing, lambda key: F.concat(_pointer(path, key), F.lit(": required"))))
        found.append(F.when(has["own"].isNotNull(), F.concat(*each)).otherwise(_none()))
    if "items" in schema:
        found.append(F.when(has["items"].isNotNull(), F.flatten(F.transform(has["items"], lambda x, i: _violations(x, schema["items"], _pointer(path, i.cast("string")), whole)))).otherwise(_none()))
    return F.concat(*found) if found else _none()
