"""The registered queries of the library's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scrivana.plans import documents, flows, notes, provenance, rules

_ALL = documents.QUERIES | notes.QUERIES | flows.QUERIES | provenance.QUERIES | rules.QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean text of the pages, packed into size-bounded chunks."""
    return documents.pages_chunks(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
