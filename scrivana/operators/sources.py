"""Indexes of sources, the relevant ones for a task, and what is missing or ambiguous."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The families in index order, those whose absence is reported, and how many candidates make a topic ambiguous.
FAMILIES = ("figma", "ui-library", "crm-code", "confluence")
REQUIRED, WIKI, MANY = FAMILIES[:3], FAMILIES[3], 3
_NONE = F.array


def normalized(sources: DataFrame, default_kind: str) -> DataFrame:
    """Sources with their defaults: a source's own kind wins over the default."""
    has = lambda c: F.col(c) if c in sources.columns else F.lit(None).cast("string")
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>")) if "tags" in sources.columns else F.array().cast("array<string>")
    more = [c for c in sources.columns if c not in ("kind", "tags", "freshness", "refresh_policy")]
    return sources.select(*more, F.coalesce(has("kind"), F.lit(default_kind)).alias("kind"), tags.alias("tags"), F.coalesce(has("freshness"), F.lit("unknown")).alias("freshness"), F.coalesce(has("refresh_policy"), F.lit("on-demand")).alias("refresh_policy"))


def source_index(figma: DataFrame, ui_library: DataFrame, crm_code: DataFrame, confluence: DataFrame, root: DataFrame | None = None) -> DataFrame:
    """The typed union of four families; where the wiki list is empty, its root page stands in for it."""
    wiki = confluence.withColumn("is_root", F.coalesce(F.col("is_root"), F.lit(False)) if "is_root" in confluence.columns else F.lit(False))
    if root is not None:
        empty = confluence.select(F.lit(1).alias("_some")).limit(1)
        alone = root.withColumn("is_root", F.lit(True)).join(empty, F.lit(True), "left_anti")
        wiki = wiki.unionByName(alone, allowMissingColumns=True)
    parts = [normalized(df, kind).withColumn("family", F.lit(k)) for k, (df, kind) in enumerate(zip((figma, ui_library, crm_code, wiki), FAMILIES, strict=True))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumn("is_root", F.coalesce("is_root", F.lit(False)))


def haystack() -> Column:
    """What scope words are looked for in."""
    return F.lower(F.concat_ws(" ", F.nullif("id", F.lit("")), F.nullif("uri", F.lit("")), F.nullif("title", F.lit("")), F.array_join(F.filter("tags", lambda t: t != ""), " ")))


def is_relevant(scope: Column, links: Column) -> Column:
    """Whether a source holds any word of a scope (an empty one matches everything), or its address any link."""
    within = F.exists(scope, lambda x: F.contains(haystack(), F.lower(x)))
    linked = F.exists(links, lambda x: F.contains(F.col("uri"), x))
    return F.coalesce(within, F.lit(False)) | F.coalesce(linked, F.lit(False))


def relevant(index: DataFrame, scope: list[str], links: list[str] = (), components: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, gaps, ambiguities) for one task. components: the part of the scope that tags name topics by."""
    strings = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    matching = index.where(is_relevant(strings(scope), strings(links)))
    # The root page stands in where no wiki page matches.
    wiki = matching.where(F.col("kind") == WIKI).select(F.lit(1).alias("_some")).limit(1)
    fallback = index.where((F.col("kind") == WIKI) & F.col("is_root")).join(wiki, F.lit(True), "left_anti").limit(1)
    sources = matching.unionByName(fallback)
    spark = index.sparkSession
    kinds = spark.createDataFrame([(k,) for k in REQUIRED], "kind string")
    missing = kinds.join(sources.select("kind").distinct(), "kind", "left_anti") if scope else kinds.limit(0)
    gaps = missing.select(F.concat(F.lit("no relevant "), "kind", F.lit(" source")).alias("reason"), F.concat("kind", F.lit(" comparison is unavailable")).alias("impact"))
    return sources, gaps, ambiguous(sources, strings(scope if components is None else components))


def ambiguous(sources: DataFrame, components: Column) -> DataFrame:
    """(topic, candidates, decision_required) of the topics (first tag that is a component) with more than MANY sources."""
    topic = F.get(F.filter("tags", lambda t: F.array_contains(components, t)), F.lit(0))
    named = sources.withColumn("topic", topic).where("topic IS NOT NULL")
    grouped = named.groupBy("topic").agg(F.array_sort(F.collect_list("id")).alias("candidates"))
    return grouped.where(F.size("candidates") > MANY).withColumn("decision_required", F.lit("choose the applicable source"))


def with_collation(df: DataFrame, name: str = "id") -> DataFrame:
    """df ordered as a reader would sort names: letters by alphabet, case and marks last."""
    return df.orderBy(F.expr(f"{name} COLLATE UNICODE"), name)
