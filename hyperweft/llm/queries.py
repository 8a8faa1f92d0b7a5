"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hyperweft.llm import decontam, exactdedup, html, langid, mixing, nearjoin, secretscan, substring, tokens, toxicity
from hyperweft.llm.common import table


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op10_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op1_mixing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.op2_token_ids(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.op3_ngram_join(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op4_language_id(table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.op5_html(table(spark, sf_dir, "pages"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.op6_secrets(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.op7_substring_dedup(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op8_decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.op9_exact_dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_token_ids": op2_token_ids,
    "op3_ngram_join": op3_ngram_join,
    "op4_language_id": op4_language_id,
    "op5_html": op5_html,
    "op6_secrets": op6_secrets,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op7_substring_dedup": substring.OP7_SQL,
    "op9_exact_dedup": exactdedup.OP9_SQL,
}
