"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivana.llm.common import forget, staged


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b); label is the smallest node of its component.

    Each round a node takes the smallest label among its neighbours' and its own, then its label's label, so
    distances halve. Labels are written to the shared folder each round, and the former ones are deleted; the loop
    ends when none changes. A node with very many neighbours has one row in the label table, and its minima are
    combined map-side; joins on it, and on a label that very many nodes have, are left to the adaptive skew join.
    """
    both = staged(spark, edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = staged(spark, both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    held = labels
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        taken = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        taken = staged(spark, taken, "labels")
        roots = taken.select(F.col("node").alias("root"), F.col("label").alias("root_label"))
        jumped = taken.join(roots, taken["label"] == roots["root"]).select("node", F.least("label", "root_label").alias("label"), "old")
        jumped = staged(spark, jumped, "labels")
        changed = not jumped.where("label <> old").isEmpty()
        forget(spark, held, taken)
        held, labels = jumped, jumped.select("node", "label")
        if not changed:
            forget(spark, both)
            return labels
