"""Readers' highlights: clippings, Markdown and CSV exports, merged and de-duplicated across sources.

Rows are (src, pos, text, location, note, kind); src orders the sources, pos the entries of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivana.functions.text import KEY_CHARS, cited, located, replaced, text_key, title_matches, trimmed, typed_location

# What separates clippings; list items that describe a book instead of quoting it.
CLIPPING_RULE = "=========="
DESCRIBING = ("author:", "full title:", "category:", "tags:", "url:")


def attach_notes(entries: DataFrame, *partition: str, pos: str = "pos", kind: str = "kind", text: str = "text") -> DataFrame:
    """Each highlight with the text of the last note that follows it before the next one; notes go.

    As-of backward by position: a running id of the last highlight groups the notes behind it. A note before any
    highlight has none to belong to and goes too.
    """
    before = Window.partitionBy(*partition).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col(kind) != "note", F.col(pos)), ignorenulls=True).over(before)
    owned = entries.withColumn("_owner", owner).where("_owner IS NOT NULL")
    notes = owned.where(F.col(kind) == "note").groupBy(*partition, "_owner").agg(F.max_by(text, pos).alias("_note"))
    found = owned.where(F.col(kind) != "note").join(notes, [*partition, "_owner"], "left")
    old = F.col("note") if "note" in entries.columns else F.lit("")
    return found.withColumn("note", F.coalesce("_note", old)).drop("_owner", "_note")


def clippings(files: DataFrame, title: str = "", author: str = "") -> DataFrame:
    """Highlights and notes of one book out of clippings files (path, text)."""
    entry = files.select("path", F.posexplode(F.split(replaced(F.col("text"), ("^﻿", ""), (r"\r\n?", "\n")), CLIPPING_RULE)).alias("pos", "entry"))
    lines = F.transform(F.split(replaced(F.col("entry"), (r"\A\n+|\n+\z", "")), "\n"), lambda x: replaced(x, (r"(?U)\s+\z", "")))
    rows = entry.withColumn("lines", lines).where(F.size("lines") >= 3)
    meta = F.lower(trimmed(F.get("lines", F.lit(1))))
    body = trimmed(F.array_join(F.slice("lines", F.lit(3), F.size("lines")), "\n"))
    kind = F.when(F.contains(meta, F.lit("your note")), "note").when(F.contains(meta, F.lit("your bookmark")), "bookmark").otherwise("highlight")
    rows = rows.select("path", "pos", trimmed(F.get("lines", F.lit(0))).alias("head"), body.alias("text"), located(meta).alias("location"), kind.alias("kind"))
    rows = rows.where((F.col("text") != "") & (F.col("kind") != "bookmark") & title_matches(F.col("head"), F.lit(title), F.lit(author)))
    return attach_notes(rows.drop("head"), "path")


def markdown_highlights(files: DataFrame, title: str = "", author: str = "") -> DataFrame:
    """List items of the Highlights part of each book's section, without describing ones."""
    sections = F.filter(F.split("text", r"(?m)(?=^#\s+[^#\s])"), lambda s: trimmed(s) != "")
    rows = files.select("path", F.posexplode(sections).alias("s", "section"))
    head = F.regexp_extract("section", r"\A#\s+([^\n]+)", 1)
    rows = rows.where((head == "") | title_matches(head, F.lit(title), F.lit(author)))
    # A section with its heading cut; where a Highlights part exists, only what follows it.
    body = F.when(head == "", F.col("section")).otherwise(F.regexp_replace("section", r"\A#[^\n]*", ""))
    named = F.regexp_extract(body, r"(?mis)^##+\s*Highlights\s*$(.*)", 1)
    region = F.when(body.rlike(r"(?mi)^##+\s*Highlights\s*$"), named).otherwise(body)
    items = rows.select("path", "s", F.posexplode(F.regexp_extract_all(region, F.lit(r"(?m)^[-*]\s+(.+?)\s*$"), 1)).alias("i", "item"))
    describing = F.lit(False)
    for word in DESCRIBING:
        describing = describing | F.lower("item").startswith(word)
    items = items.withColumn("item", trimmed(F.col("item"))).where((F.col("item") != "") & ~describing).withColumn("c", cited(F.col("item")))
    pos = (F.col("s") * F.lit(1 << 20) + F.col("i")).alias("pos")
    return items.where("c.text <> ''").select("path", pos, "c.text", "c.location", F.lit("").alias("note"), F.lit("highlight").alias("kind"))


def csv_highlights(rows: DataFrame, title: str = "", author: str = "") -> DataFrame:
    """Highlights of a table of exported rows; either column may name the book. pos orders the rows."""
    col = lambda name: F.coalesce(F.col(f"`{name}`"), F.lit("")) if name in rows.columns else F.lit("")
    book = F.coalesce(F.nullif(col("Book Title"), F.lit("")), F.nullif(col("Title"), F.lit("")), F.lit(""))
    found = rows.where(title_matches(book, F.lit(title), F.lit(author)) & (trimmed(col("Highlight")) != ""))
    return found.select("path", "pos", trimmed(col("Highlight")).alias("text"), typed_location(col("Location Type"), col("Location")).alias("location"), trimmed(col("Note")).alias("note"), F.lit("highlight").alias("kind"))


def bag_union(*sources: DataFrame) -> DataFrame:
    """All entries of the sources; src tells their order."""
    out = sources[0].withColumn("src", F.lit(0))
    for k, s in enumerate(sources[1:], 1):
        out = out.unionByName(s.withColumn("src", F.lit(k)))
    return out


def keep_first(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key by `order`; rows without a key go. The order must have no ties.

    The first row of each key is found by partial minima (one row per task and key), not by sorting each key's rows.
    """
    keyed = df.withColumn("_key", key).where(F.col("_key") != "")
    first = F.min(F.struct(*order, F.struct(*[F.col(c) for c in df.columns]).alias("row")))
    return keyed.groupBy("_key").agg(first.alias("first")).select("first.row.*")


def unique_highlights(entries: DataFrame, *order: str) -> DataFrame:
    """The first of entries whose wording is equal over its first KEY_CHARS characters."""
    return keep_first(entries, F.substring(text_key(F.col("text")), 1, KEY_CHARS), *(order or ("src", "pos")))


def source_counts(entries: DataFrame) -> DataFrame:
    """(src, n, unique): entries and distinct wordings of each source."""
    key = F.nullif(F.substring(text_key(F.col("text")), 1, KEY_CHARS), F.lit(""))
    return entries.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("unique"))


def rendered(entries: DataFrame) -> DataFrame:
    """(n, line): a Markdown list of highlights, with location and note."""
    place = F.when(F.col("location") != "", F.concat(F.lit(" — "), F.col("location"))).otherwise("")
    note = F.when(F.col("note") != "", F.concat(F.lit("\n    note: "), F.col("note"))).otherwise("")
    return entries.select("src", "pos", F.concat(F.lit("> "), F.col("text"), place, note).alias("line"))
