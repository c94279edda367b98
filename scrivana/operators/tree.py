"""Discovering a tree of pages from an edge table.

The depth-first order of a walk is the lexicographic order of the paths of child positions, and the walk meets a page
first on the least of its paths. Paths are found in rounds: each page keeps its least path so far, and only pages whose
path got smaller pass it on, so a round has a row for each edge at most, however many ways lead to a page. Meetings
of a page other than its first, and ways back to an ancestor, are gaps of reason 'cycle'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivana.session import cut

# Why a page is left out, and what that means.
GAPS = {"inaccessible": "descendant body and children unavailable", "cycle": "cyclic descendant skipped"}
#: Rounds after which a walk is given up; a page at depth n needs n rounds at least.
MAX_DEPTH = 100


def walk(spark: SparkSession, edges: DataFrame, root: str, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """(pages, gaps) below root out of edges (parent_id, child_id, child_pos, inaccessible), ids as strings.

    pages: id, parent_id, depth, walk (array of positions; its order is the walk's).
    """
    edges = cut(edges.select("parent_id", "child_id", F.col("child_pos").cast("long").alias("pos"), F.coalesce("inaccessible", F.lit(False)).alias("closed")))
    onward = lambda pages: pages.join(edges, pages["id"] == edges["parent_id"]).select("child_id", pages["id"].alias("parent_id"), (F.col("depth") + 1).alias("depth"), F.concat("walk", F.array("pos")).alias("walk"), "closed")
    pages = spark.range(1).select(F.lit(root).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"), F.array().cast("array<bigint>").alias("walk"))
    changed = pages
    for _ in range(max_depth):
        met = onward(changed).where("NOT closed").groupBy(F.col("child_id").alias("id")).agg(F.min(F.struct("walk", "parent_id", "depth")).alias("first"))
        known = pages.select("id", F.col("walk").alias("known"))
        changed = cut(met.join(known, "id", "left").where("known IS NULL OR first.walk < known").select("id", "first.parent_id", "first.depth", "first.walk"))
        if changed.isEmpty():
            break
        pages = cut(pages.join(changed.select("id"), "id", "left_anti").unionByName(changed))
    else:
        raise ValueError(f"the walk from {root} isn't done after {max_depth} rounds")
    meetings = onward(pages).select(F.col("child_id").alias("id"), "walk", "closed")
    cycles = meetings.where("NOT closed").join(pages.select("id", "walk"), ["id", "walk"], "left_anti").select("id", "walk", F.lit("cycle").alias("reason"))
    gaps = cycles.unionByName(meetings.where("closed").select("id", "walk", F.lit("inaccessible").alias("reason")))
    impact = F.when(F.col("reason") == "cycle", GAPS["cycle"]).otherwise(GAPS["inaccessible"])
    return pages, gaps.select(F.col("id").alias("source_id"), "reason", impact.alias("impact"), "walk")


def failed_children(pages: DataFrame, failures: DataFrame) -> DataFrame:
    """Gaps of the pages whose children couldn't be listed, out of failures (parent_id, message)."""
    hit = failures.join(pages, failures["parent_id"] == pages["id"], "left_semi")
    return hit.select(F.col("parent_id").alias("source_id"), F.lit("child-discovery-failed").alias("reason"), F.col("message").alias("impact"))
