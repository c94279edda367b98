"""Snapshots of sources, their digests, and material differences between two of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivana.functions.canonical import canonical_struct, digest_struct

# Change types in the order in which the first that applies is reported, and the tail's order.
SOURCE_CHANGES = ("added", "removed", "body-changed", "accessibility-changed")
TAIL = (("scope", "scope-changed"), ("library_decisions", "library-decisions-changed"), ("gaps", "gap-changed"), ("ambiguities", "ambiguity-changed"))


def snapshot_source() -> list[Column]:
    """The columns of a snapshot's source; `body` itself isn't kept, only its digest."""
    return [
        F.col("id"), F.col("kind"), F.col("uri"), F.col("page_id"), F.col("page_version"),
        F.coalesce(digest_struct(F.struct("body")), F.col("body_digest")).alias("body_digest"),
        F.coalesce("accessible", ~F.coalesce("body_unavailable", F.lit(False))).alias("accessible"),
        F.col("last_successful_retrieval_at"),
    ]


def diff_sources(previous: DataFrame, following: DataFrame, key: str = "id", body: str = "body_digest", accessible: str = "accessible") -> DataFrame:
    """(source_id, type) of the sources that differ; of several differences the first of SOURCE_CHANGES."""
    side = lambda df, n: df.select(F.col(key).alias("source_id"), F.col(body).alias(f"b{n}"), F.col(accessible).alias(f"a{n}"), F.lit(True).alias(f"in{n}"))
    both = side(previous, 1).join(side(following, 2), "source_id", "full_outer")
    change = (
        F.when(F.col("in1").isNull(), SOURCE_CHANGES[0]).when(F.col("in2").isNull(), SOURCE_CHANGES[1])
        .when(~F.col("b1").eqNullSafe(F.col("b2")), SOURCE_CHANGES[2]).when(~F.col("a1").eqNullSafe(F.col("a2")), SOURCE_CHANGES[3])
    )
    return both.select("source_id", change.alias("type")).where("type IS NOT NULL")


def compare(previous: DataFrame, following: DataFrame, by: str = "task_id") -> DataFrame:
    """(by, position, source_id, type): the changes between two snapshots of each task, in order.

    Each side has a row per task: sources (array of structs with id, body_digest, accessible) and scope,
    library_decisions, gaps, ambiguities. Order of keys and time of retrieval make no difference.
    """
    exploded = lambda df: df.select(by, F.explode("sources").alias("s")).select(F.struct(by, "s.id").alias("id"), "s.body_digest", "s.accessible")
    first = diff_sources(exploded(previous), exploded(following)).select(F.col(f"source_id.{by}").alias(by), F.lit(0).alias("rank"), F.col("source_id.id").alias("source_id"), "type")
    pairs = previous.alias("p").join(following.alias("f"), by)
    tail = [F.when(~canonical_struct(F.struct(F.col(f"p.{c}"))).eqNullSafe(canonical_struct(F.struct(F.col(f"f.{c}")))), F.struct(F.lit(k + 1).alias("rank"), F.lit(t).alias("type"))) for k, (c, t) in enumerate(TAIL)]
    rest = pairs.select(by, F.explode(F.filter(F.array(*tail), lambda x: x.isNotNull())).alias("t")).select(by, "t.rank", F.lit(None).cast("string").alias("source_id"), "t.type")
    from pyspark.sql import Window

    order = Window.partitionBy(by).orderBy("rank", "source_id")
    return first.unionByName(rest).withColumn("position", F.row_number().over(order)).drop("rank")


def snapshots(sources: DataFrame, contexts: DataFrame, created_at: Column, by: str = "task_id") -> DataFrame:
    """A row per task: sources in collation order of their ids (letters by alphabet, lower case first), source_digest (sources, scope, decisions) and id (everything)."""
    one = sources.select(by, *snapshot_source())
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.collate("id", "UNICODE").alias("k"), *[c for c in one.columns if c != by]))), lambda s: s.dropFields("k"))
    grouped = one.groupBy(by).agg(ordered.alias("sources"))
    both = contexts.join(grouped, by, "left").withColumn("sources", F.coalesce("sources", F.array().cast(grouped.schema["sources"].dataType)))
    parts = ["sources", "scope", "library_decisions"]
    both = both.withColumn("created_at", created_at).withColumn("source_digest", digest_struct(F.struct(*parts)))
    return both.withColumn("snapshot_id", digest_struct(F.struct(by, "created_at", "source_digest", *parts, "gaps", "ambiguities")))


def refreshed(sources: DataFrame, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, gaps): stale and unknown sources take their fetched body (id, body, error); others stay.

    A source whose body is missing keeps its provenance and is reported as a gap; a failed fetch is a row, not a
    failed job.
    """
    due = F.coalesce("freshness", F.lit("unknown")).isin("stale", "unknown")
    got = fetched.select(F.col("id").alias("fid"), F.col("body").alias("new_body"), F.col("error").alias("error"))
    both = sources.join(got, due & (F.col("id") == F.col("fid")), "left").withColumn("due", due).withColumn("ok", F.col("due") & F.col("error").isNull() & F.col("new_body").isNotNull())
    keep = [F.col(c) for c in sources.columns if c not in ("freshness", "body", "accessible", "body_unavailable")]
    body = F.col("body") if "body" in sources.columns else F.lit(None).cast("string")
    out = both.select(
        *keep, F.when(F.col("ok"), "fresh").otherwise(F.coalesce("freshness", F.lit("unknown"))).alias("freshness"),
        F.when(F.col("ok"), F.col("new_body")).otherwise(body).alias("body"),
        F.when(F.col("ok"), True).when(F.col("due"), False).alias("accessible"), (F.col("due") & ~F.col("ok")).alias("body_unavailable"),
    )
    reason = F.when(F.col("error").isNotNull(), "refresh-failed").otherwise("body-unavailable")
    gaps = both.where("due AND NOT ok").select(F.col("id").alias("source_id"), reason.alias("reason"), F.coalesce("error", F.lit("source body unavailable")).alias("impact"))
    return out, gaps
