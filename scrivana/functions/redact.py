"""Redaction of nested JSON: sensitive keys masked or removed at any depth, assignments masked in strings."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scrivana.functions.uri import SENSITIVE

# Names whose fields a rendered artifact leaves out.
HIDDEN = "approval|credential|secret|token|source.?bod|hash|digest"
MASK = "[REDACTED]"


def _tree(text: Column, change, needed: Column) -> Column:
    """JSON changed by a Python function; rows that don't need it stay in the JVM."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(change(json.loads(t)), ensure_ascii=False, separators=(",", ":")), na_action="ignore")

    return F.when(needed, run(text)).otherwise(text)


def redacted(text: Column, sensitive: str = SENSITIVE) -> Column:
    """Canonical JSON in which the values of sensitive keys, and of assignments within strings, are masked."""
    key, assigned = re.compile(sensitive, re.I), re.compile(rf"({sensitive})\s*[:=]\s*[^\s,;&]+", re.I)

    def change(value):
        if isinstance(value, dict):
            return {k: MASK if key.search(k) else change(v) for k, v in value.items()}
        if isinstance(value, list):
            return [change(v) for v in value]
        return assigned.sub(rf"\1={MASK}", value) if isinstance(value, str) else value

    plain = F.to_json(F.try_parse_json(text))
    return _tree(plain, change, plain.rlike(f"(?i){sensitive}"))


def without_hidden(text: Column, hidden: str = HIDDEN) -> Column:
    """Canonical JSON without the fields whose names are hidden, at any depth."""
    key = re.compile(hidden, re.I)

    def change(value):
        if isinstance(value, dict):
            return {k: change(v) for k, v in value.items() if not key.search(k)}
        return [change(v) for v in value] if isinstance(value, list) else value

    plain = F.to_json(F.try_parse_json(text))
    return _tree(plain, change, plain.rlike(rf"(?i){hidden}"))


def projected(value: Column, *fields: str) -> Column:
    """JSON of some fields of a VARIANT only; those that are missing are null."""

    def of(v: Column) -> Column:
        parts = [F.concat(F.lit(f'"{f}":'), F.coalesce(F.to_json(F.try_variant_get(v, f"$['{f}']", "variant")), F.lit("null"))) for f in fields]
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))

    return F.transform(F.array(value), of)[0]  # the value is parsed once, not for each field
