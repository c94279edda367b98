"""Prepare the documents table for training: five stages, each over all that the one before kept.

encoded() writes every stage's rows as Parquet to the shared folder and reads them back as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scrivana.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from scrivana.llm.common import documents, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from sf_dir's labels of the documents it gets."""
    return toxicity.toxicity_stage(spark, docs, sf_dir)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact_dedup.dedup_stage(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the smallest doc_id stays."""
    return near_dedup.near_dedup_stage(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix draws them, up to twice each."""
    return mixing.mixing_stage(spark, docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each row, with their number and the digests of the ids and of the bytes they decode to."""
    return bpe.encoding_stage(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", tokenize),
]

#: A classifier, MinHash and a splitting tree have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir: the encoded corpus."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded corpus without its ids: op2's columns."""
    return encoded(spark, sf_dir).drop("ids")
