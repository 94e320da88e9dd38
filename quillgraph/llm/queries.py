"""The queries opN_<name>, each over its whole table, and what SQL says of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, licenses, mixing, neardup, quality, secrets, tokens, toxicity, warc
from .common import table
from .oracle import ORACLE_SQL  # noqa: F401


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), whole=True)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat(table(spark, sf_dir, "conversations"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(spark, table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(spark, table(spark, sf_dir, "pages"))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(spark, table(spark, sf_dir, "documents")).drop("source", "h")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.digest(spark, table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count(spark, table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_chat_formatting, op3_secret_scans, op4_warc, op5_license_scans,
        op6_mixing, op7_quality_rules, op8_toxicity, op9_near_dedup, op10_token_counts,
    )
}
