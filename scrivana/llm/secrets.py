"""Secret scans with corpus-wide ownership frequency.

One pass over the texts finds the base spans by pattern (kinds assign, access, hex) and further candidates:
long runs of credential characters that look alive (letters and digits, many distinct characters) and aren't
inside a base span (kind owned). The candidates' hashes are then aggregated over the corpus by distinct
repositories (documents) and owners (sources), after a count in each task. A candidate that several owners
or many repositories have is a widely copied example; one that belongs to one owner and few repositories is
taken for a live credential, and its span is added. Base spans always stay; for them the same frequency is
reported as the number of owner-specific and of widely copied ones.

Positions come from two arrays per kind, the matches and the texts between them: a match starts where all
earlier ones and the texts before it end. The sums run in blocks, so that a very long text with very many
matches takes time in proportion to their number.

Defined cases: a null text is empty and has no spans; a null doc_id stays null; a null source is an owner of its own;
repeated rows are repositories of their own; a very long text is one row, scanned whole; an empty table gives an empty
result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivana.llm.common import let, packed, staged

#: The base patterns with the least length of what they find, in the order of the kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST, ACCESS, HEX = 12, r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
#: Further candidates: least length, least number of distinct characters.
CREDENTIAL, DISTINCT = r"[A-Za-z0-9+/_-]{20,}", 10
#: A live credential has at most so many owners and repositories.
MAX_OWNERS, MAX_REPOSITORIES = 1, 3
_BLOCK = 256
_KINDS = ("assign", "access", "hex", "owned")


def prefix_sums(lengths: Column) -> Column:
    """Inclusive running sums of an array of numbers, in blocks."""
    def of(a: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _BLOCK).cast("int"))
        total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)
        sums = F.transform(blocks, lambda b: total(F.slice(a, b * _BLOCK + 1, F.lit(_BLOCK))))
        starts = lambda s: F.transform(blocks, lambda b: total(F.slice(s, F.lit(1), b)))
        inner = lambda p: F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: let(F.floor((i - 1) / _BLOCK).cast("int"), lambda b: F.element_at(p, b + 1) + total(F.slice(a, b * _BLOCK + 1, i - b * _BLOCK))))
        return let(sums, lambda s: let(starts(s), inner))

    return F.when(F.size(lengths) == 0, F.array().cast("array<bigint>")).otherwise(let(lengths, of))


def matches(text: Column, pattern: str, kind: str, value_group: int = 0) -> Column:
    """array of (start, end, kind, value) of the leftmost non-overlapping matches, in code points."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:string,value:string>>")

    def of(m: Column) -> Column:
        lengths = F.transform(m, lambda x: F.length(x).cast("long"))
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
        values = F.regexp_extract_all(text, F.lit(pattern), value_group) if value_group else m

        def placed(z: Column) -> Column:
            # ends[i] is the sum of the gaps and matches up to the i-th
            pairs = F.zip_with(F.slice(z["gaps"], F.lit(1), F.size(z["lengths"])), z["lengths"], lambda g, n: g + n)
            spans = F.arrays_zip(prefix_sums(pairs).alias("end"), z["lengths"].alias("length"), z["values"].alias("value"))
            return F.transform(spans, lambda x: F.struct((x["end"] - x["length"]).alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")))

        return F.when(F.size(m) == 0, none).otherwise(let(F.struct(lengths.alias("lengths"), gaps.alias("gaps"), values.alias("values")), placed))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), of)


def base_spans(text: Column) -> tuple[Column, Column, Column]:
    """The base spans by kind.

    Matches of access and hex that are too short are left out by the pattern itself: such a match is a whole
    run, or the rest of one, and nothing that overlaps it is longer. An assignment that is too short may hide
    another keyword in what it consumed, so it is matched first and dropped after.
    """
    assign = F.filter(matches(text, ASSIGN, "assign", 2), lambda x: F.length(x["value"]) >= ASSIGN_LEAST)
    return assign, matches(text, ACCESS, "access"), matches(text, HEX, "hex")


def alive(value: Column) -> Column:
    """Whether a string looks like a live credential: digits, letters, and many distinct characters."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT)


def ordered(spans: Column) -> Column:
    """Spans by start, then kind as listed."""
    rank = lambda x: F.array_position(F.array(*[F.lit(k) for k in _KINDS]), x["kind"]).cast("int")
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), rank(x).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.sort_array(keyed)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(loc, doc_id, owner, base, more) of every row, written once; spans carry the hash of their value."""
    rows = packed(spark, docs).select("loc", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.source").cast("string").alias("owner"), F.coalesce(F.col("row.text"), F.lit("")).alias("text"))
    assign, access, hexes = base_spans(F.col("text"))
    found = rows.select("loc", "doc_id", "owner", F.concat(assign, access, hexes).alias("base"), F.filter(matches(F.col("text"), CREDENTIAL, "owned"), lambda x: alive(x["value"])).alias("more"))
    apart = F.filter("more", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    hashed = lambda a: F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), F.substring(F.unhex(F.sha2(x["value"].cast("binary"), 256)), 1, 16).alias("hash")))
    return staged(spark, found.select("loc", "doc_id", "owner", hashed(F.col("base")).alias("base"), hashed(apart).alias("more")), "secret-spans")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repositories) of each candidate value: distinct sources and documents."""
    held = F.explode(F.array_distinct(F.transform(F.concat("base", "more"), lambda x: x["hash"]))).alias("hash")
    each = found.where("size(base) + size(more) > 0").select("owner", held).groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))


def scan_secrets(spark: SparkSession, docs: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """(loc, doc_id, base, added, n_specific, n_copied) of every row: spans and the ownership of their values."""
    found = scan(spark, docs)
    own = ownership(found).where((F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)).select("hash")
    # Only owner-specific values are joined back: each of them has max_repositories rows at most.
    spans = found.where("size(base) + size(more) > 0").select("loc", F.explode(F.concat("base", "more")).alias("span")).select("loc", "span", F.col("span.hash").alias("hash"))
    specific = spans.join(own, "hash").groupBy("loc").agg(F.collect_list("span").alias("specific"))
    found = found.join(specific, "loc", "left").withColumn("specific", F.coalesce("specific", F.array().cast(specific.schema["specific"].dataType)))
    added = F.filter("specific", lambda x: x["kind"] == "owned")
    known = F.size(F.filter("specific", lambda x: x["kind"] != "owned"))
    return found.select("loc", "doc_id", "base", added.alias("added"), known.cast("long").alias("n_specific"), (F.size("base") - known).cast("long").alias("n_copied"))


def op9(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's columns, and how many base spans hold owner-specific and widely copied values."""
    found = scan_secrets(spark, docs)
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base, spans = written(ordered(F.col("base"))), written(ordered(F.concat("base", "added")))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"), "n_specific", "n_copied")
