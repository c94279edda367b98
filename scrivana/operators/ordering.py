"""Numbering rows in an order that spans all of them, without sorting them in one task.

The order's keys are cut at bounds that stem from a small, hash-picked part of them; rows are numbered within their
bucket, and each bucket starts where the ones before it end. Any bounds give the same numbers, so the pick decides
how even the buckets are and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bucket, about; keys that are looked at for each bound; bounds at most.
BUCKET_ROWS, PICKED, MOST_BOUNDS = 1_000_000, 32, 1_000


def bounds(df: DataFrame, keys: list[Column], rows: int = BUCKET_ROWS) -> list:
    """Key values (structs, ascending) that cut df into buckets of about `rows` rows; none if it fits in one."""
    count = df.count()
    wanted = min(MOST_BOUNDS, -(-count // rows) - 1)
    if wanted < 1:
        return []
    share = max(1, count // (wanted * PICKED))
    key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    picked = df.select(key.alias("key")).where(F.pmod(F.xxhash64("key"), F.lit(share)) == 0).distinct()
    found = [r.key for r in picked.orderBy(F.xxhash64("key"), "key").limit(4 * wanted * PICKED).orderBy("key").collect()]
    return [found[(k + 1) * len(found) // (wanted + 1)] for k in range(wanted)] if len(found) > wanted else found


def numbered(df: DataFrame, keys: list[Column], name: str, rows: int = BUCKET_ROWS) -> DataFrame:
    """df with a column that counts from 1 in the order of the keys; keys must have no ties and no nulls.

    One partial count of the buckets, and one shuffle by bucket.
    """
    cuts = bounds(df, keys, rows)
    key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    bucket = F.lit(0)
    for cut in cuts:
        bucket = bucket + (key >= F.struct(*[F.lit(v).alias(f"k{i}") for i, v in enumerate(cut)])).cast("int")
    placed = df.withColumn("_bucket", bucket)
    counts = placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    ahead = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys))
    # One row for each bucket: MOST_BOUNDS + 1 at most.
    return placed.withColumn("_within", within).join(F.broadcast(ahead), "_bucket").withColumn(name, (F.col("_before") + F.col("_within")).cast("long")).drop("_bucket", "_within", "_before")
