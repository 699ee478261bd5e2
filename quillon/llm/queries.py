"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontamination, licenses, linededup, mixing, neardedup, quality, secrets, suffixdedup, toxicity, vectordedup
from quillon.llm.common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.digest(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), quality.trusted_of(table(spark, sf_dir, "labels")))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_line_dedup": op2_line_dedup,
        "op3_near_dedup": op3_near_dedup,
        "op4_quality": op4_quality,
        "op5_license_scan": op5_license_scan,
        "op6_secret_scan": op6_secret_scan,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_mix_sources": op8_mix_sources,
        "op9_decontaminate": op9_decontaminate,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_dedup": suffixdedup.ORACLE,
        "op2_line_dedup": linededup.ORACLE,
        "op3_near_dedup": neardedup.ORACLE,
        "op7_embedding_dedup": vectordedup.ORACLE,
        "op8_mix_sources": mixing.ORACLE,
        "op9_decontaminate": decontamination.ORACLE,
    }
