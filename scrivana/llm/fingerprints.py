"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the k smallest distinct 64-bit hashes of a document's shingles (runs of five words; with fewer
words, all of them as one), sorted. Sketches of parts merge into the sketch of the whole, and they estimate
resemblance, containment and the number of distinct shingles; sets of up to k shingles are exact.

The query also compares each document with the next one in descending order of doc_id. That order is global,
so it is cut at keys of existing rows into buckets of about BUCKET_BYTES of text, whatever the ids look like: the
key is (doc_id, first bytes of the text, hash of the locator), so that missing and repeated ids are cut as well.
Texts are shuffled once, by bucket, and sketched and sorted there. A bucket's first row goes to the bucket before it as
well, to follow its last row. The cuts come from a range partitioning of the keys alone.

Defined cases: a null text is empty; a text without words has an empty sketch, which is like another empty
one (1.0) and unlike any other (0.0); a very long text is one row of its bucket; null doc_ids come last (with the
least 64-bit number, if that is an id); rows with the same doc_id follow each other by the first seven bytes of
their text, then by a hash of their place; a single document is its own next one; repeated rows are rows of their own; an empty table gives an empty result;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivana.llm.common import forget, let, staged, texts, words

K, SHINGLE = 128, 5
#: Text in a bucket, about, and the most buckets.
BUCKET_BYTES, MOST_BUCKETS = 4 << 20, 1 << 17
#: Buckets that a task is made for, about.
BUCKETS_A_TASK = 8
_EMPTY = "array<bigint>"


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The bottom-k sketch of a text."""
    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (shingle - 1), F.lit(1)))
        return F.when(F.size(w) == 0, F.array().cast(_EMPTY)).otherwise(bottom(F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, F.lit(shingle)))), k))

    return let(words(text), of)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated intersection over union; 1 for two empty sketches."""
    return let(merged(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, k).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; 1 where a is empty."""
    both = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def corpus_sketch(sketches: DataFrame, by: str, column: str = "sketch", k: int = K, salts: int = 64) -> DataFrame:
    """(by, sketch) merged over all rows of each group, k hashes from each of `salts` parts of a group first."""
    parts = sketches.select(by, F.explode(column).alias("h")).distinct().withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(salts)))
    few = parts.withColumn("rank", F.row_number().over(Window.partitionBy(by, "salt").orderBy("h"))).where(F.col("rank") <= k)
    return few.groupBy(by).agg(F.slice(F.sort_array(F.collect_list("h")), 1, k).alias(column))


def to_text(a: Column) -> Column:
    """A sketch as a string: its hashes in hexadecimal, 16 digits each."""
    return F.lower(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def descending(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, text, k0, k1, k2) of docs; the numbers' ascending order is the descending one of doc_id, nulls last."""
    down = F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1)).alias("k0")
    start = F.conv(F.rpad(F.hex(F.substring(F.encode("text", "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long").alias("k1")
    return texts(spark, docs).select("doc_id", "text", down, start, F.xxhash64("loc").alias("k2"))


def cuts(spark: SparkSession, keyed: DataFrame, bucket_bytes: int) -> list[tuple[int, int, int]]:
    """The first key of each bucket, in order: keys of rows, one for every `bucket_bytes` of text, about."""
    slim = staged(spark, keyed.select("k0", "k1", "k2", F.octet_length("text").alias("n")), "order-keys")
    size = slim.agg(F.sum("n")).first()[0] or 0
    parts = int(min(MOST_BUCKETS, max(1, -(-size // bucket_bytes))))
    ranged = slim.repartitionByRange(parts, "k0", "k1", "k2")
    rows = ranged.groupBy(F.spark_partition_id()).agg(F.min(F.struct("k0", "k1", "k2")).alias("first")).select("first.*").collect()
    forget(spark, slim)
    return sorted(tuple(r) for r in rows)


def bucket_of(found: list[tuple[int, int, int]]) -> Column:
    """struct(bucket, first): a row's bucket, by binary search of k0, k1, k2 in the cuts, and whether it is its first row."""
    columns = [F.lit(np.array([c[k] for c in found], dtype=np.int64)) for k in range(3)]
    mine = F.struct("k0", "k1", "k2")
    at = lambda i: F.struct(*[F.element_at(c, i + 1).alias(f"k{k}") for k, c in enumerate(columns)])
    ahead = lambda step: lambda p: F.when(p + step >= len(found), p).when(at(p + step) <= mine, p + step).otherwise(p)
    place = F.lit(0)  # the last cut that isn't above the row
    for power in reversed(range(max(1, len(found) - 1).bit_length())):
        place = let(place, ahead(1 << power))
    return let(place, lambda p: F.struct(p.alias("bucket"), (at(p) == mine).alias("first")))


def with_next(spark: SparkSession, docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, text, fp, next_text, next_fp): each row with the next one's by descending doc_id."""
    keyed = descending(spark, docs)
    found = cuts(spark, keyed, bucket_bytes)
    if not found:
        return keyed.select("doc_id", "text", sketch(F.col("text")).alias("fp"), F.col("text").alias("next_text"), sketch(F.col("text")).alias("next_fp"))
    keyed = keyed.withColumn("at", bucket_of(found)).select("doc_id", "text", "k0", "k1", "k2", F.col("at.bucket").alias("bucket"), F.col("at.first").alias("first"))
    home = lambda bucket, guest: F.struct(bucket.alias("bucket"), F.lit(guest).alias("guest"))
    before = F.pmod(F.col("bucket") - 1, F.lit(len(found))).cast("int")
    homes = F.when(F.col("first"), F.array(home(F.col("bucket"), False), home(before, True))).otherwise(F.array(home(F.col("bucket"), False)))
    placed = keyed.select("doc_id", "text", "k0", "k1", "k2", F.explode(homes).alias("home")).select("doc_id", "text", "k0", "k1", "k2", "home.*")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-len(found) // BUCKETS_A_TASK))
    placed = placed.repartition(parts, "bucket").withColumn("fp", sketch(F.col("text")))
    # A guest comes after all rows of its bucket, though its key may be the least of all (the first row follows the last).
    order = Window.partitionBy("bucket").orderBy("guest", "k0", "k1", "k2")
    return placed.withColumn("next_text", F.lead("text").over(order)).withColumn("next_fp", F.lead("fp").over(order)).where("NOT guest")


def op5(spark: SparkSession, docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The contract's columns, and the estimated number of distinct shingles."""
    found = with_next(spark, docs, bucket_bytes)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    found = found.select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("edited"))
    found = found.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fp", "next_fp", sketch(F.col("edited")).alias("edited_fp"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", to_text(F.col("fp")).alias("fingerprint"), to_text(F.col("edited_fp")).alias("edited_fingerprint"),
        resemblance(F.col("fp"), F.col("edited_fp")).alias("near_edited"), resemblance(F.col("fp"), F.col("next_fp")).alias("near_next"),
        distinct_shingles(F.col("fp")).alias("n_shingles"),
    )
