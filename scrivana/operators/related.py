"""Related notes by weighted token overlap, and sets of tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivana.functions.text import title_tokens

# Weight of a shared topic, number of notes given.
TOPIC_WEIGHT, LIMIT = 3, 8


def overlap(left: Column, right: Column) -> Column:
    """Number of shared members of two sets."""
    return F.size(F.array_intersect(left, right)).cast("long")


def scored(notes: DataFrame, topics: list[str], title: str, exclude: str = "") -> DataFrame:
    """notes (basename, title, tags) with score; notes without overlap, and the excluded one, go.

    The wanted topics and words are literals, so each note is scored where it is read.
    """
    wanted = F.array(*[F.lit(t.strip().lower()) for t in topics if t.strip()]).cast("array<string>")
    hits = overlap(F.transform("tags", F.lower), wanted)
    words = overlap(title_tokens(F.coalesce("title", F.lit("")), F.col("basename")), title_tokens(F.lit(title)))
    found = notes.withColumn("tag_hits", hits).withColumn("title_hits", words)
    found = found.where((F.col("tag_hits") + F.col("title_hits") > 0) & (F.lower("basename") != exclude.lower()))
    return found.withColumn("score", F.col("tag_hits") * TOPIC_WEIGHT + F.col("title_hits"))


def related(notes: DataFrame, topics: list[str], title: str, exclude: str = "", limit: int = LIMIT, tie: str = "basename") -> DataFrame:
    """The `limit` notes of the highest score, then by name."""
    return scored(notes, topics, title, exclude).orderBy(F.desc("score"), F.lower("basename"), tie).limit(limit)


def related_pairs(notes: DataFrame, queries: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The best notes for each of many queries (query_id, topics, title).

    Topics and words are exploded and joined on the token, so only pairs with something in common arise; hits are
    counted map-side first.
    """
    def parts(df: DataFrame, key: str, topics: Column, words: Column) -> DataFrame:
        one = lambda kind, a: F.transform(a, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("token")))
        return df.select(key, F.explode(F.concat(one("topic", F.array_distinct(F.transform(topics, F.lower))), one("word", words))).alias("p")).select(key, "p.kind", "p.token")

    left = parts(notes, "basename", F.col("tags"), title_tokens(F.coalesce("title", F.lit("")), F.col("basename")))
    right = parts(queries, "query_id", F.col("topics"), title_tokens(F.coalesce("title", F.lit(""))))
    weight = F.sum(F.when(F.col("kind") == "topic", TOPIC_WEIGHT).otherwise(1))
    score = left.join(right, ["kind", "token"]).groupBy("query_id", "basename").agg(weight.alias("score"))
    from pyspark.sql import Window

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.lower("basename"), "basename")
    return score.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
