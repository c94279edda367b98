"""Canonical JSON and its digests.

Objects' keys are sorted at every depth and lists keep their order, by a round trip through VARIANT. Digests are
stable within this engine; numbers in exponent form and integer-like keys may be written in another way elsewhere.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Left out of plan and edit digests at any depth.
APPROVAL_FIELDS = ("approval", "approvalReceipt")


def canonical(text: Column) -> Column:
    """Canonical form of a JSON text; null if it is none."""
    return F.to_json(F.try_parse_json(text))


def canonical_struct(value: Column) -> Column:
    """Canonical JSON of a struct, map or array, nulls included."""
    return canonical(F.to_json(value, {"ignoreNullFields": "false"}))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form."""
    return F.sha2(canonical(text), 256)


def digest_struct(value: Column) -> Column:
    return F.sha2(canonical_struct(value), 256)


def without_fields(text: Column, names: tuple[str, ...] = APPROVAL_FIELDS) -> Column:
    """Canonical JSON without the fields of these names at any depth (one Arrow call; only where one occurs)."""
    def cut(value):
        if isinstance(value, dict):
            return {k: cut(v) for k, v in value.items() if k not in names}
        return [cut(v) for v in value] if isinstance(value, list) else value

    @F.pandas_udf(StringType())
    def drop(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(cut(json.loads(t)), ensure_ascii=False), na_action="ignore")

    plain = canonical(text)
    occurs = F.lit(False)
    for n in names:
        occurs = occurs | F.contains(plain, F.lit(f'"{n}":'))
    return canonical(F.when(occurs, drop(plain)).otherwise(plain))


def strict_timestamp(text: Column) -> Column:
    """Whether text is an ISO timestamp with milliseconds and Z (session time zone UTC)."""
    shape = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$")
    back = F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") == text
    return F.coalesce(shape & back, F.lit(False))


def plan_digest(plan: Column, snapshot_id: Column, context_digest: Column) -> Column:
    """Digest of a plan (JSON text) bound to a context; null where an id is missing."""
    bound = F.concat(F.lit('{"contextDigest":'), F.to_json(context_digest.cast("string").cast("variant")), F.lit(',"contextSnapshotId":'), F.to_json(snapshot_id.cast("string").cast("variant")), F.lit(',"plan":'), without_fields(plan), F.lit("}"))
    given = (F.coalesce(snapshot_id, F.lit("")) != "") & (F.coalesce(context_digest, F.lit("")) != "") & F.get_json_object(plan, "$.id").isNotNull()
    return F.when(given, F.sha2(bound, 256))


def edit_digest(plan_id: Column, edits: Column) -> Column:
    """Digest of a list of edits (JSON text), in their order, bound to a plan."""
    is_list = F.schema_of_variant(F.try_parse_json(edits)).startswith("ARRAY")
    bound = F.concat(F.lit('{"edits":'), without_fields(edits), F.lit(',"planId":'), F.to_json(plan_id.cast("variant")), F.lit("}"))
    return F.when((F.coalesce(plan_id, F.lit("")) != "") & is_list, F.sha2(bound, 256))


def collected_digest(rows: DataFrame, by: list[str], order: str, *fields: str) -> DataFrame:
    """(by, n, digest): digest of each group's rows as a list in an order without ties."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(order, *[f for f in fields if f != order]))), lambda x: x)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), items.alias("items")).select(*by, "n", digest_struct(F.col("items")).alias("digest"))
