"""Writers: chunks, indexes, published documents and the list of links to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivana.functions.text import replaced, trimmed
from scrivana.operators.ordering import numbered


def write_chunks(index: DataFrame, path: str, by: str) -> None:
    """A folder of text for each document, its chunks' texts in order; a rerun replaces only its documents."""
    rows = index.select(by, "n", F.col("body").alias("value"))
    rows.repartition(by).sortWithinPartitions(by, "n").select(by, "value").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).text(path)


def write_index(index: DataFrame, path: str) -> None:
    """A JSON line for each chunk, without its text."""
    index.drop("body").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_notes_index(notes: DataFrame, path: str) -> None:
    notes.write.mode("overwrite").json(path)


def publish(documents: DataFrame, path: str, by: str = "target") -> None:
    """Write documents to their targets; publishing again replaces the targets that are written, and no others."""
    documents.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def existing(stems: DataFrame, published: DataFrame) -> DataFrame:
    """The stems that are published already."""
    return stems.join(published.select("stem").distinct(), "stem", "left_semi")


def link(stem: Column) -> Column:
    return F.concat(F.lit("- [["), stem, F.lit("]]"))


def upserted_links(lines: DataFrame, stems: DataFrame) -> DataFrame:
    """(part, pos, line) of a list of links after adding some: its head, then all distinct links by name.

    lines: (pos, line). Links are ordered without regard to case, then by themselves, so that there are no ties.
    """
    bare = trimmed(F.col("line"))
    is_link = bare.startswith("- [[") & bare.endswith("]]")
    head = lines.where(~is_link)
    first = F.min(F.when(bare != "", F.col("pos")))
    last = F.max(F.when(bare != "", F.col("pos")))
    bounds = head.agg(first.alias("first"), last.alias("last"))
    head = head.join(F.broadcast(bounds), F.col("pos").between(F.col("first"), F.col("last"))).select(F.lit(0).alias("part"), "pos", "line")
    gap = bounds.where("last IS NOT NULL").select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("pos"), F.lit("").alias("line"))
    links = lines.where(is_link).select(bare.alias("line")).unionByName(stems.select(link(F.col("stem")).alias("line"))).distinct()
    links = numbered(links, [F.lower("line"), F.col("line")], "pos")
    return head.unionByName(gap).unionByName(links.select(F.lit(2).alias("part"), "pos", "line"))


def with_plain_images(text: Column) -> Column:
    """Embeds of the form ![[name.ext|200]] as plain Markdown images."""
    return replaced(text, (r"(?m)^!\[\[([^\]|]+?)(?:\|[^\]]*)?\]\]$", r"![]($1)"))
