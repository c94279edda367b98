"""Readers: files by extension, notes with front matter, clippings and exports, metadata records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivana.functions import text as T

# What each extension is read as, and folders that hold no notes.
KINDS = {
    "epub": "epub", "pdf": "pdf", "txt": "text", "text": "text", "md": "text", "markdown": "text", "docx": "docx",
    "html": "html", "htm": "html", "xhtml": "html",
}
SKIPPED = (".git", ".obsidian", ".trash", "node_modules")
LIST_KEYS = ("tags", "topics", "aliases")
SUBJECTS, PUBLISHERS = 12, 5


def kind_of(path: Column) -> Column:
    """What a file is read as, by its extension; null if unsupported."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for name, kind in KINDS.items():
        out = F.when(extension == name, kind).otherwise(out)
    return out


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, content, length) of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content", "length")


def texts(given: DataFrame, closed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(texts, rejects) of files (path, content): text and HTML files as text with word and character counts.

    Files of an unsupported kind, and of kinds that need a converter of their own, are rejects with a reason.
    closed: see strip_html_full.
    """
    kinds = given.withColumn("kind", kind_of(F.col("path")))
    raw = F.try_validate_utf8(F.decode("content", "UTF-8"))
    read = kinds.where(F.col("kind").isin("text", "html")).withColumn("text", F.when(F.col("kind") == "html", T.strip_html_full(raw, closed)).otherwise(raw))
    out = read.select("path", "kind", "text", T.word_count(F.col("text")).alias("words"), F.length("text").cast("long").alias("chars"), T.extraction_note(F.col("text")).alias("note"))
    reason = F.when(F.col("kind").isNull(), "unsupported input").otherwise("needs a converter")
    return out, kinds.where(~F.coalesce(F.col("kind").isin("text", "html", "epub"), F.lit(False))).select("path", "kind", reason.alias("reason"))


def front_matter(text: Column) -> Column:
    """map<string, array<string>> of a note's head: 'key: value', '[a, b]' lists, and '- x' blocks for LIST_KEYS."""
    head = F.regexp_extract(text, r"\A---(?s)(.*?)\n---", 1)
    lines = F.filter(F.split(head, r"\r?\n"), lambda x: x != "")
    fold = "array<struct<key:string,values:array<string>>>"
    bare = lambda x: F.btrim(F.trim(x), F.lit("'\""))

    def step(a: Column, line: Column) -> Column:
        key, value = F.lower(F.regexp_extract(line, r"^([A-Za-z0-9_-]+):", 1)), F.regexp_extract(line, r"^[A-Za-z0-9_-]+:(.*)$", 1)
        listed = key.isin(*LIST_KEYS)
        values = F.when(listed, F.coalesce(T.inline_list(value), F.array().cast("array<string>"))).otherwise(F.array(bare(value)))
        last = F.element_at(a, -1)
        item = F.regexp_extract(line, r"^\s*-\s+(.*)$", 1)
        grown = F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last["key"].alias("key"), F.concat(last["values"], F.array(bare(item))).alias("values"))))
        return F.when(key != "", F.concat(a, F.array(F.struct(key.alias("key"), values.alias("values"))))).when(line.rlike(r"^\s*-\s+") & (F.size(a) > 0) & F.coalesce(last["key"].isin(*LIST_KEYS), F.lit(False)), grown).otherwise(a)

    pairs = F.aggregate(lines, F.array().cast(fold), step)
    # A key that occurs again replaces the earlier one.
    kept = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(kept)


def notes(given: DataFrame) -> DataFrame:
    """(path, basename, title, tags) of Markdown files (path, text), without dot folders and SKIPPED ones."""
    skipped = F.exists(F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1), lambda d: F.coalesce(d.rlike(r"^\.[^.]") | d.isin(*SKIPPED), F.lit(False)))
    rows = given.where(F.col("path").endswith(".md") & ~skipped).withColumn("fm", front_matter(F.col("text")))
    base = F.regexp_extract("path", r"([^/]*)\.md$", 1)
    return rows.select("path", base.alias("basename"), F.coalesce(F.nullif(F.get(F.try_element_at("fm", F.lit("title")), F.lit(0)), F.lit("")), base).alias("title"), T.tags(F.try_element_at("fm", F.lit("tags")), F.try_element_at("fm", F.lit("topics"))).alias("tags"))


def with_authors(works: DataFrame, authors: DataFrame) -> DataFrame:
    """(work_id, authors): names in order; an author whose key has no name is given by the key. works: (work_id, authors array<struct<key, name>>)."""
    each = works.select("work_id", F.posexplode("authors").alias("pos", "a"))
    named = each.join(authors.select(F.col("key").alias("k"), F.col("name").alias("n")), F.col("a.key") == F.col("k"), "left")
    name = F.when(F.col("a.key").isNull(), F.nullif("a.name", F.lit(""))).otherwise(F.coalesce("n", "a.key"))
    return named.groupBy("work_id").agg(F.transform(F.array_sort(F.collect_list(F.when(name.isNotNull(), F.struct("pos", name.alias("name"))))), lambda x: x["name"]).alias("authors"))


def book_metadata(records: DataFrame) -> DataFrame:
    """Metadata of records: lists capped, the year out of the date, empty values null."""
    full = lambda c: F.when(F.size(c) > 0, c)
    return records.select("work_id", F.nullif("title", F.lit("")).alias("title"), T.year_from(F.col("publish_date")).alias("year"), full(F.slice("publishers", 1, PUBLISHERS)).alias("publishers"), full(F.slice("subjects", 1, SUBJECTS)).alias("subjects"), F.get("isbns", F.lit(0)).alias("isbn"))


def first_found(*lookups: DataFrame, key: str = "work_id") -> DataFrame:
    """For each key the row of the first look-up that has one."""
    out = lookups[0].withColumn("_rank", F.lit(0))
    for k, df in enumerate(lookups[1:], 1):
        out = out.unionByName(df.withColumn("_rank", F.lit(k)), allowMissingColumns=True)
    rest = [c for c in out.columns if c not in (key, "_rank")]
    return out.groupBy(key).agg(F.min_by(F.struct(*rest), "_rank").alias("r")).select(key, "r.*")


def covers(given: DataFrame, least: int = 1000) -> DataFrame:
    """Image files (content) that are large enough to be a cover, with their kind by the first bytes."""
    return given.where(F.length("content") >= least).withColumn("kind", T.image_kind(F.col("content")))
