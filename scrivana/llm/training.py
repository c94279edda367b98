"""Labelled samples for the classifiers, bounded by a parameter."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivana.llm.common import labels


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of doc_id as text, modulo `of`."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of))


@dataclass
class Sample:
    """Texts, their labels, and how many labelled rows each stands for."""

    texts: list[str]
    marks: np.ndarray
    weights: np.ndarray


def labelled_sample(docs: DataFrame, marks: DataFrame, label: str, learn: Column, rows: int, even: bool) -> Sample:
    """About `rows` labelled rows at most for which `learn` (on doc_id) holds, in a fixed order.

    even: half of them of either class, as far as there are so many; each row then stands for more of its class.
    The rows are picked by a hash of doc_id from the labels alone, so the list of ids that is broadcast, like
    the texts that come to the driver, has `rows` rows at most, whatever the input's size.
    """
    marked = marks.where(learn & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    totals = {0: 0, 1: 0} | {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sum(totals.values()):
        return Sample([], np.zeros(0, np.int64), np.zeros(0))
    take = {c: rows * n / max(rows, sum(totals.values())) for c, n in totals.items()}
    if even:
        few = min(totals, key=totals.get)
        take[few] = min(totals[few], rows / 2)
        take[1 - few] = min(totals[1 - few], rows - take[few])
    scale = 1 << 30
    shares = {c: min(1.0, take[c] / max(1, totals[c])) for c in totals}
    under = F.when(F.col("label") == 1, F.lit(int(scale * shares[1]))).otherwise(F.lit(int(scale * shares[0])))
    # Cut in a fixed order, so that repeated ids and labels give the same sample in every run.
    order = F.xxhash64("doc_id", F.lit(label))
    picked = marked.where(F.pmod(order, F.lit(scale)) < under).orderBy(order, "doc_id", "label").limit(2 * rows)
    found = doc_texts(docs).join(F.broadcast(picked), "doc_id").orderBy(order, "doc_id", "label", "text").limit(2 * rows).toPandas()
    found = found.sort_values(["doc_id", "label", "text"], kind="stable")
    y = found["label"].to_numpy(np.int64)
    return Sample(found["text"].tolist(), y, np.where(y == 1, 1 / max(shares[1], 1e-9), 1 / max(shares[0], 1e-9)))


def doc_texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def sample_of(spark: SparkSession, docs: DataFrame, sf_dir: str, label: str, of: int, held_out: int, rows: int, even: bool = False) -> Sample:
    return labelled_sample(docs, labels(spark, sf_dir), label, fold(F.col("doc_id"), of) != held_out, rows, even)
