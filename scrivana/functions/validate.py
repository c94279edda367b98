"""Validating JSON against a subset of JSON Schema.

A schema is compiled once, on the driver, to one Column of error texts; rows are validated inside the JVM. A field
that is missing and one that is null differ, so values are read from VARIANT. All errors are listed, in the order
of the schema; a value of a wrong type ends its own branch only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrivana.functions.canonical import strict_timestamp

# The keywords and formats that are understood.
KEYWORDS = ("type", "required", "properties", "items", "enum", "pattern", "format", "minLength", "minimum")
FORMATS = ("date-time",)
_KIND = {"STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}


class UnsupportedSchema(ValueError):
    """A schema with a keyword or format that isn't understood."""


def check_schema(schema: dict, path: str = "$") -> None:
    """Raise UnsupportedSchema if any part of a schema isn't understood."""
    unknown = [k for k in schema if k not in KEYWORDS]
    if unknown:
        raise UnsupportedSchema(f"Unsupported schema keyword {unknown[0]} at {path}")
    for name, child in schema.get("properties", {}).items():
        check_schema(child, f"{path}.properties.{name}")
    if "items" in schema:
        check_schema(schema["items"], f"{path}.items")
    if schema.get("format", FORMATS[0]) not in FORMATS:
        raise UnsupportedSchema(f"Unsupported schema format {schema['format']} at {path}")


def kind(value: Column) -> Column:
    """The JSON type of a VARIANT: object, array, string, boolean, null, integer or number."""

    def of(v: Column) -> Column:
        simple = F.when(v["name"].startswith("OBJECT"), "object").when(v["name"].startswith("ARRAY"), "array")
        for spark_name, json_name in _KIND.items():
            simple = simple.when(v["name"] == spark_name, json_name)
        return simple.when(v["whole"] == F.floor(v["whole"]), "integer").when(v["whole"].isNotNull(), "number")

    return _let(F.struct(F.schema_of_variant(value).alias("name"), F.try_variant_get(value, "$", "double").alias("whole")), of)


def _named(types: list[str]) -> str:
    return " or ".join({"array": "an array", "object": "an object"}.get(t, f"a {t}") for t in types)


def _error(wrong: Column, text: Column | str) -> Column:
    text = F.lit(text) if isinstance(text, str) else text
    return F.when(F.coalesce(wrong, F.lit(False)), F.array(text)).otherwise(F.array().cast("array<string>"))


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def errors(schema: dict, value: Column, path: Column | str = "$") -> Column:
    """array<string> of the errors of a VARIANT; what the checks look at is worked out once."""
    at = F.lit(path) if isinstance(path, str) else path
    keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
    seen = F.struct(value.alias("value"), kind(value).alias("of"), F.try_variant_get(value, "$", "string").alias("text"), keys.alias("keys"), at.alias("at"))
    return _let(seen, lambda v: _errors(schema, v))


def _errors(schema: dict, v: Column) -> Column:
    value, of, text, at = v["value"], v["of"], v["text"], v["at"]
    types = [schema["type"]] if isinstance(schema.get("type"), str) else list(schema.get("type", []))
    found: list[Column] = []
    if "enum" in schema:
        allowed = [F.lit(e if isinstance(e, str) else str(e)) for e in schema["enum"]]
        found.append(_error(~F.coalesce(text, F.lit("null")).isin(*allowed), F.concat(at, F.lit(" must equal one of " + ", ".join(map(str, schema["enum"]))))))
    if "minLength" in schema:
        found.append(_error((of == "string") & (F.length(text) < schema["minLength"]), F.concat(at, F.lit(f" must have length at least {schema['minLength']}"))))
    if "pattern" in schema:
        found.append(_error((of == "string") & ~text.rlike(schema["pattern"]), F.concat(at, F.lit(f" must match {schema['pattern']}"))))
    if "minimum" in schema:
        found.append(_error(of.isin("integer", "number") & (F.try_variant_get(value, "$", "double") < schema["minimum"]), F.concat(at, F.lit(f" must be at least {schema['minimum']}"))))
    if "format" in schema:
        found.append(_error((of != "string") | ~strict_timestamp(text), F.concat(at, F.lit(" must be an ISO-8601 timestamp"))))
    has = lambda name: F.coalesce(F.array_contains(v["keys"], name), F.lit(False))
    for name in schema.get("required", []):
        found.append(_error((of == "object") & ~has(name), F.concat(at, F.lit(f".{name} is required"))))
    for name, child in schema.get("properties", {}).items():
        inside = errors(child, F.try_variant_get(value, f"$['{name}']", "variant"), F.concat(at, F.lit(f".{name}")))
        found.append(F.when((of == "object") & has(name), inside).otherwise(F.array().cast("array<string>")))
    if "items" in schema:
        each = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x, i: errors(schema["items"], x, F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))
        found.append(F.when(of == "array", F.flatten(each)).otherwise(F.array().cast("array<string>")))
    listed = F.concat(*found) if found else F.array().cast("array<string>")
    if not types:
        return listed
    fits = of.isin(*types) | ((of == "integer") & F.lit("number" in types))
    return F.when(fits, listed).otherwise(F.array(F.concat(at, F.lit(f" must be {_named(types)}"))))


def validated(schema: dict, text: Column, *more: Column) -> Column:
    """array<string> of the errors of a JSON text; `more` are texts of further checks, null where they pass."""
    check_schema(schema)
    own = _let(F.try_parse_json(text), lambda given: F.when(given.isNull(), F.array(F.lit("$ must be JSON"))).otherwise(errors(schema, given)))
    return F.concat(own, F.filter(F.array(*more), lambda x: x.isNotNull())) if more else own


def required_when(text: Column, when: Column, names: Iterable[str], why: str) -> list[Column]:
    """Further checks: fields that must be there when a condition holds."""
    keys = F.map_keys(F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>"))
    return [F.when(when & ~F.coalesce(F.array_contains(keys, n), F.lit(False)), F.lit(f"$.{n} is required {why}")) for n in names]
