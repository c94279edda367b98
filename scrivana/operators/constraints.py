"""Data-quality constraints: equality of declarations, versions, required members, unique rows, sentences, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivana.functions.text import replaced, trimmed

# Semantic Versioning 2.0.
_NUMBER = "(?:0|[1-9][0-9]*)"
_BEFORE = f"(?:{_NUMBER}|[0-9]*[A-Za-z-][0-9A-Za-z-]*)"
SEMVER = rf"^{_NUMBER}\.{_NUMBER}\.{_NUMBER}(?:-{_BEFORE}(?:\.{_BEFORE})*)?(?:\+[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?$"


def mismatches(declared: DataFrame, actual: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, declared, actual) of the fields that differ; a key that one side lacks differs in all."""
    both = declared.alias("d").join(actual.alias("a"), key, "full_outer")
    each = [F.struct(F.lit(f).alias("field"), F.col(f"d.{f}").cast("string").alias("declared"), F.col(f"a.{f}").cast("string").alias("actual")) for f in fields]
    rows = both.select(key, F.explode(F.array(*each)).alias("x")).select(key, "x.*")
    return rows.where(~F.col("declared").eqNullSafe(F.col("actual")))


def is_semver(version: Column) -> Column:
    return F.coalesce(version.rlike(SEMVER), F.lit(False))


def version_errors(manifests: DataFrame, package: str = "package", version: str = "version") -> DataFrame:
    """(package, error): a version that is invalid or missing, else versions that differ within a package."""
    rolled = manifests.groupBy(package).agg(F.bool_and(is_semver(F.col(version))).alias("fine"), F.count_distinct(version).alias("n"))
    error = F.when(~F.col("fine"), "invalid or missing SemVer version").when(F.col("n") > 1, "version mismatch")
    return rolled.select(package, error.alias("error")).where("error IS NOT NULL")


def missing(required: DataFrame, present: DataFrame, key: str | list[str]) -> DataFrame:
    """The required rows that aren't there."""
    return required.join(present, key, "left_anti")


def not_unique(required: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of the required keys that don't have exactly one row."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return required.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n <> 1")


def sentences(text: Column) -> Column:
    """The sentences of a text in lower case, white space squeezed."""
    one = replaced(trimmed(text), (r"(?U)\s+", " "))
    return F.filter(F.transform(F.split(one, r"(?<=[.!?])\s+"), lambda s: F.lower(F.trim(s))), lambda s: s != "")


def missing_sentences(required: DataFrame, texts: DataFrame, by: str) -> DataFrame:
    """(by, sentence) of the required sentences that a text doesn't have exactly."""
    have = texts.select(by, F.explode(sentences(F.col("text"))).alias("key")).distinct()
    return required.withColumn("key", F.lower("sentence")).join(have, [by, "key"], "left_anti").drop("key")


def relative_links(text: Column) -> Column:
    """Targets of Markdown links that aren't web addresses or places in the same text, without their fragments."""
    found = F.regexp_extract_all(text, F.lit(r"\[[^\]]+\]\(([^)]+)\)"), 1)
    local = F.filter(found, lambda x: ~(x.startswith("https://") | x.startswith("http://") | x.startswith("#")))
    return F.transform(local, lambda x: F.regexp_extract(x, "^([^#]*)", 1))


def broken_links(texts: DataFrame, files: DataFrame) -> DataFrame:
    """(path, target) of relative links to files that don't exist; absolute ones are broken too. files: (path)."""
    from scrivana.functions.uri import joined_path

    links = texts.select("path", F.explode(relative_links(F.col("text"))).alias("target"))
    links = links.withColumn("wanted", joined_path(F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.col("target")))
    found = links.join(files.select(F.col("path").alias("wanted")).distinct(), "wanted", "left_semi").where(~F.col("target").startswith("/"))
    return links.join(found.select("path", "target").distinct(), ["path", "target"], "left_anti").select("path", "target")


# Keys and plain values of strict front matter.
_KEY, _VALUE = r"^[a-z][a-z0-9_-]*\z", r"^[A-Za-z0-9][^\r\n]*\z"


def strict_front_matter(text: Column) -> Column:
    """struct(error, entries array<struct<key, value, items>>, body): a head of 'key: value' lines and '  - item' lists.

    The first line that doesn't fit ends the reading; entries and body are null then.
    """
    whole = r"\A---\n((?s).*?)\n---\n"
    head = F.regexp_extract(text, whole, 1)
    kind = "array<struct<key:string,value:string,items:array<string>>>"
    state = lambda error, entries, open_: F.struct(error.cast("string").alias("error"), entries.alias("entries"), open_.alias("open"))
    plain = lambda v: v.rlike(_VALUE) & ~F.contains(v, F.lit(": ")) & ~v.endswith(":") & ~F.contains(v, F.lit(" #"))
    none = F.lit(None).cast("string")
    fail = lambda a, why: state(why, a["entries"], F.lit(False))
    unfilled = lambda a: a["open"] & (F.size(F.element_at(a["entries"], -1)["items"]) == 0)

    def step(a: Column, line: Column) -> Column:
        item, last = F.substring(line, 5, 1 << 30), F.element_at(a["entries"], -1)
        grown = F.struct(last["key"].alias("key"), last["value"].alias("value"), F.concat(last["items"], F.array(item)).alias("items"))
        listed = F.when(~a["open"], fail(a, F.concat(F.lit("unexpected list item: "), line))).when(~plain(item), fail(a, F.concat(F.lit("invalid value: "), item))).otherwise(state(none, F.concat(F.slice(a["entries"], F.lit(1), F.size(a["entries"]) - 1), F.array(grown)), F.lit(True)))
        key, value = F.regexp_extract(line, r"^([^:]+):(?: (.*))?\z", 1), F.regexp_extract(line, r"^[^:]+: (.*)\z", 1)
        has_value = line.rlike(r"^[^:]+: ")
        entry = F.struct(key.alias("key"), F.when(has_value, value).alias("value"), F.array().cast("array<string>").alias("items"))
        added = (
            F.when(unfilled(a), fail(a, F.lit("empty list"))).when(key == "", fail(a, F.concat(F.lit("invalid entry: "), line))).when(~key.rlike(_KEY), fail(a, F.concat(F.lit("invalid key: "), key)))
            .when(F.exists(a["entries"], lambda e: e["key"] == key), fail(a, F.concat(F.lit("duplicate key: "), key))).when(has_value & ~plain(value), fail(a, F.concat(F.lit("invalid value: "), value)))
            .otherwise(state(none, F.concat(a["entries"], F.array(entry)), ~has_value))
        )
        return F.when(a["error"].isNotNull(), a).when(line.startswith("  - "), listed).otherwise(added)

    begin = state(none, F.array().cast(kind), F.lit(False))
    read = F.aggregate(F.split(head, "\n"), begin, step, lambda a: F.struct(F.when(a["error"].isNotNull(), a["error"]).when(unfilled(a), F.lit("empty list")).alias("error"), a["entries"].alias("entries")))
    error = F.when(~text.rlike(whole), "invalid front matter").when(F.contains(head, F.lit("\t")), "tabs are not supported").otherwise(read["error"])
    fine = error.isNull()
    return F.struct(error.alias("error"), F.when(fine, read["entries"]).alias("entries"), F.when(fine, trimmed(F.regexp_replace(text, whole, ""))).alias("body"))
