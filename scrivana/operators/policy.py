"""Allow-lists for sources, and which repository a task is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivana.functions import uri as U
from scrivana.functions.text import replaced

# Source kinds and reasons for a rejection.
DESIGN, WIKI, REPOSITORY = "figma", "confluence", "repository"
UNKNOWN, INVALID, UNAPPROVED = "unknown-source-kind", "invalid-uri", "unapproved-host"


def authorized(sources: DataFrame, hosts: dict[str, list[str]], remotes: list[str]) -> DataFrame:
    """sources (kind, uri) with allowed, normalized and reason.

    hosts: allowed hosts by kind. The lists are a policy's settings; they become literals, so no join is needed.
    """
    allowed = {k: [h.lower().removeprefix("www.") for h in v] for k, v in hosts.items()}
    among = lambda c, xs: F.coalesce(c.isin(*xs), F.lit(False)) if xs else F.lit(False)
    kind, link, page, remote = F.col("kind"), U.https(F.col("uri")), U.page_id(F.col("uri"), WIKI), U.git_remote(F.col("uri"))
    known = F.coalesce(kind.isin(DESIGN, WIKI, REPOSITORY), F.lit(False))
    normal = F.when(kind == DESIGN, link["uri"]).when(kind == WIKI, page["uri"]).when(kind == REPOSITORY, remote)
    own = F.array(*[F.lit(r) for r in remotes]).cast("array<string>")
    fine = (
        F.when(kind == DESIGN, among(link["host"], allowed.get(DESIGN, [])))
        .when(kind == WIKI, page["host"].isNull() | among(page["host"], allowed.get(WIKI, [])))
        .otherwise(F.array_contains(F.transform(own, U.git_remote), remote))
    )
    reason = F.when(~known, UNKNOWN).when(normal.isNull(), INVALID).when(~F.coalesce(fine, F.lit(False)), UNAPPROVED)
    return sources.withColumn("normalized", F.when(known, normal)).withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull())


def partitioned(decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted sources, gaps of the rejected ones); to be called before anything is fetched."""
    gaps = decided.where("NOT allowed").select(F.col("id").alias("source_id"), "reason", F.lit("source was rejected before retrieval").alias("impact"))
    return decided.where("allowed"), gaps


def _segments(path: Column) -> Column:
    return F.split(replaced(F.lower(path), (r"\\", "/")), "/")


def repository_evidence(repository: Column, name: Column, scope: Column, artifacts: Column, target: str, part: str) -> Column:
    """array<struct<kind, source, value>>: why a task is, or may be, about the target repository."""
    item = lambda kind, source, value: F.struct(F.lit(kind).alias("kind"), F.lit(source).cast("string").alias("source"), value.alias("value"))
    partly = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(part)), F.lit(False))
    remote = U.git_remote(repository)
    exact = F.coalesce(remote.endswith(f"/{target}"), F.lit(False))
    first = F.when(exact, F.array(item("normalized-remote", None, remote))).when(partly(repository), F.array(item("partial-name-match", "repository", repository)))
    second = F.when(partly(name), F.array(item("partial-name-match", "repositoryName", name)))

    def paths(values: Column, source: str) -> Column:
        given = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v) != "")
        one = lambda v: F.when(F.array_contains(_segments(v), target), item("path-segment", source, v)).when(partly(v), item("partial-name-match", source, v))
        return F.filter(F.transform(given, one), lambda x: x.isNotNull())

    parts = [first, second, paths(scope, "repositoryScope"), paths(artifacts, "changedArtifacts")]
    empty = F.array().cast("array<struct<kind:string,source:string,value:string>>")
    return F.concat(*[F.coalesce(p, empty) for p in parts])


def repository_target(evidence: Column, target: str) -> Column:
    """The target, 'ambiguous' where only part of its name is met, else 'other'."""
    exact = F.exists(evidence, lambda e: e["kind"].isin("normalized-remote", "path-segment"))
    return F.when(exact, target).when(F.size(evidence) > 0, "ambiguous").otherwise("other")
