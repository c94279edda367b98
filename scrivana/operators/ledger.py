"""A ledger of lessons: duplicates by wording and scope, proposals, approvals with a version that counts up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivana.functions.text import lesson_key, lesson_tokens, scope_key
from scrivana.operators.ordering import numbered


def _keyed(df: DataFrame, side: str) -> DataFrame:
    return df.select(F.col("id").alias(side), "class", lesson_key(F.col("lesson")).alias("key"), scope_key(F.col("scope")).alias("scope_key"), lesson_tokens(F.col("lesson")).alias("tokens"))


def exact_duplicates(entries: DataFrame, proposals: DataFrame) -> DataFrame:
    """(proposal, entry) of equal class, wording and scope set."""
    return _keyed(proposals, "proposal").join(_keyed(entries, "entry"), ["class", "key", "scope_key"]).select("proposal", "entry")


def overlaps(entries: DataFrame, proposals: DataFrame) -> DataFrame:
    """(proposal, entry) of equal class that share a scope and a token and aren't exact duplicates.

    Both sides are exploded by scope and joined on (class, scope); the token test runs on the joined pairs. A scope
    that very many entries have makes that many candidates, which is what it asks for.
    """
    left = _keyed(proposals, "proposal").withColumn("scope", F.explode("scope_key"))
    right = _keyed(entries, "entry").withColumn("scope", F.explode("scope_key")).withColumnRenamed("tokens", "of_entry")
    pairs = left.join(right.select("entry", "class", "scope", "of_entry"), ["class", "scope"]).where(F.arrays_overlap("tokens", "of_entry"))
    return pairs.select("proposal", "entry").distinct().join(exact_duplicates(entries, proposals), ["proposal", "entry"], "left_anti")


def proposed(corrections: DataFrame) -> DataFrame:
    """Proposals out of corrections (id, classification, lesson, evidence, scope)."""
    kind = F.when(F.col("classification") == "stable-rule", "stable-rule").otherwise("task-exception")
    empty = F.array().cast("array<string>")
    return corrections.select(F.concat(F.lit("proposal:"), "id").alias("id"), kind.alias("class"), "lesson", F.coalesce("evidence", empty).alias("evidence"), F.coalesce("scope", empty).alias("scope"), F.col("id").alias("correction_id"), F.lit(False).alias("persisted"))


def decided(proposals: DataFrame, entries: DataFrame, decisions: DataFrame, version: int, order: str = "id") -> DataFrame:
    """proposals with outcome, error and version out of decisions (id, decision, approved_at).

    A proposal with duplicates needs an explicit decision: discard, create-distinct, or link:<id of a duplicate>.
    Approved ones become entries; each approval raises the version by one, in the given order.
    """
    same = exact_duplicates(entries, proposals).unionByName(overlaps(entries, proposals)).groupBy("proposal").agg(F.collect_set("entry").alias("duplicates"))
    both = proposals.join(same, proposals["id"] == same["proposal"], "left").drop("proposal").join(decisions, "id", "left").withColumn("duplicates", F.coalesce("duplicates", F.array().cast("array<string>")))
    said, linked = F.col("decision"), F.col("decision").startswith("link:")
    explicit = F.coalesce(said.isin("discard", "create-distinct") | linked, F.lit(False))
    unknown = F.coalesce(linked, F.lit(False)) & ~F.array_contains("duplicates", F.substring(said, 6, 1 << 30))
    error = F.when((F.size("duplicates") > 0) & ~explicit, "explicit duplicate decision is required before persistence").when(unknown, F.concat(F.lit("duplicate lesson not found: "), F.substring(said, 6, 1 << 30)))
    both = both.withColumn("error", error)
    outcome = F.when(F.col("error").isNotNull(), "pending").when(F.coalesce((said == "discard") | linked, F.lit(False)), "rejected").otherwise("approved")
    both = both.withColumn("outcome", outcome)
    approved = numbered(both.where("outcome = 'approved'"), [F.col(order)], "nth")
    approved = approved.withColumn("version", (F.lit(version) + F.col("nth")).cast("long")).drop("nth")
    return approved.unionByName(both.where("outcome <> 'approved'").withColumn("version", F.lit(None).cast("long")))


def read(ledger: DataFrame) -> Column:
    """The version of a ledger, 1 where it has none."""
    return F.coalesce(F.max("version"), F.lit(1))
