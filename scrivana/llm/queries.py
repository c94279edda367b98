"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scrivana.llm import bpe, exact_dedup, fingerprints, mixing, near_dedup, quality, secrets, spans, suffix_dedup, toxicity
from scrivana.llm.common import documents
from scrivana.llm.oracles import SQL


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op1(spark, documents(spark, sf_dir), sf_dir)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op2(spark, documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.op3(spark, documents(spark, sf_dir))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.op4(spark, documents(spark, sf_dir))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.op5(spark, documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op6(spark, documents(spark, sf_dir), sf_dir)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op7(spark, documents(spark, sf_dir))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.op8(spark, documents(spark, sf_dir))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op9(spark, documents(spark, sf_dir))


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.op10(spark, documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_byte_bpe, op3_exact_dedup, op4_minhash, op5_fingerprints, op6_quality, op7_mixing, op8_suffix_array, op9_secrets, op10_sentence_spans)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
