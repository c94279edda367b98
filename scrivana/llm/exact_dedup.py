"""Exact dedup by stateful streaming.

Every row becomes an entry (digest, doc_id, content locator) of a log in the shared folder. A streaming
query folds the log into keyed state in RocksDB, on disk and without expiry: for each digest the entry
that stays (largest doc_id) and the number of copies. Entries of one digest are combined before they are
shuffled, so a group that holds a third of all rows reaches its state as one row from each task. Digests
with hits are then checked on the full bytes: equal texts collapse map-side, and a digest under which two
different texts met is resolved by the texts themselves.

Defined cases: a null text is empty, and empty texts are equal; a null doc_id is smaller than any other;
of repeated rows with the same largest doc_id the one with the largest locator stays; a very long text is digested
whole and travels whole where its digest has hits; an empty table gives an empty result; other columns are carried along whole, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivana.llm.common import ascii_lower, conf_during, new_folder, packed, staged

#: The state is on disk. Without preallocation, a store takes the space of what it holds.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def digest_log(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, log): packed documents, and (loc, doc_id, sha) of each, written once."""
    rows = packed(spark, docs)
    sha = F.unhex(F.sha2(ascii_lower(F.coalesce(F.col("row.text"), F.lit(""))).cast("binary"), 256))
    return rows, staged(spark, rows.select("loc", F.col("row.doc_id").cast("long").alias("doc_id"), sha.alias("sha")), "digest-log")


def fold_log(spark: SparkSession, log: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """(digest, keep, copies) of the digests with more than one copy, out of the streaming state."""
    folder = new_folder(spark, "dedup-state")
    path = log.inputFiles()
    if not path:
        return log.select(F.col("sha").alias("digest"), F.struct("doc_id", "loc").alias("keep"), F.lit(0).cast("long").alias("copies")).limit(0)
    entries = spark.readStream.schema(log.schema).parquet(path[0].rsplit("/", 1)[0])
    state = entries.groupBy(F.substring("sha", 1, digest_bytes).alias("digest")).agg(F.max(F.struct("doc_id", "loc")).alias("keep"), F.count(F.lit(1)).alias("copies"))
    epochs: list[int] = []

    def sink(changed: DataFrame, epoch: int) -> None:
        changed.where("copies > 1").write.mode("overwrite").parquet(f"{folder}/changed/epoch={epoch}")
        epochs.append(epoch)

    with conf_during(spark, **STATE):
        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(sink).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()
    changed = spark.read.schema(state.schema).parquet(*[f"{folder}/changed/epoch={e}" for e in sorted(set(epochs))])
    if len(set(epochs)) == 1:
        return changed
    # A digest's later entries replace its earlier ones; the number of copies only grows.
    return changed.groupBy("digest").agg(F.max(F.struct("copies", "keep")).alias("last")).select("digest", "last.keep", "last.copies")


def exact_dedup(spark: SparkSession, docs: DataFrame, digest_bytes: int = 32) -> tuple[DataFrame, DataFrame]:
    """(rows, decisions): decisions hold loc, doc_id, sha, keep_id, group_size, kept for every row.

    digest_bytes: how much of the SHA-256 keys the state; fewer only in tests, to make digests collide.
    """
    rows, log = digest_log(spark, docs)
    classes = staged(spark, fold_log(spark, log, digest_bytes), "dedup-classes")
    log = log.withColumn("digest", F.substring("sha", 1, digest_bytes))
    found = log.join(classes, "digest", "left")
    # Full bytes of the hits. Grouping by the text itself combines copies in each task.
    hits = log.join(classes, "digest", "left_semi").select(F.col("loc"), "digest")
    full = rows.select("loc", F.col("row.doc_id").cast("long").alias("doc_id"), ascii_lower(F.coalesce(F.col("row.text"), F.lit(""))).alias("norm")).join(hits, "loc")
    by_text = full.groupBy("digest", "norm").agg(F.max(F.struct("doc_id", "loc")).alias("keep"), F.count(F.lit(1)).alias("copies"))
    clashes = staged(spark, by_text.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "dedup-clashes")
    if not clashes.isEmpty():
        apart = by_text.join(clashes, "digest", "left_semi")
        right = full.join(apart, ["digest", "norm"]).select("loc", F.struct("keep", "copies").alias("own"))
        found = found.join(right, "loc", "left").withColumn("keep", F.coalesce("own.keep", "keep")).withColumn("copies", F.coalesce("own.copies", "copies"))
    alone = F.col("copies").isNull()
    decided = found.select(
        "loc", "doc_id", "sha",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("keep.loc") == F.col("loc"))).alias("kept"),
    )
    return rows, decided


def op3(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's columns for every row of docs."""
    _, decided = exact_dedup(spark, docs)
    return decided.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def dedup_stage(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without all but one of equal texts; the columns are those of docs."""
    rows, decided = exact_dedup(spark, docs)
    return rows.join(decided.where("NOT kept").select("loc"), "loc", "left_anti").select("row.*")


OP3_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""
