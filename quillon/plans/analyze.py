"""The whole analysis of a folder of mails."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import scoring as S
from quillon.operators.mails import aggregate_mails, blocks, has_ocr_text, ocr_text, score_blocks
from quillon.sources.eml import read_mails
from quillon.sources.ocr import read_images
from quillon.sources.providers import by_rules
from quillon.sources.sinks import report_entries, write_full_report

@dataclass(frozen=True)
class Config:
    """Settings, from the environment unless given."""

    input_dir: str = os.environ.get("QUILLON_INPUT", "data/raw")
    report: str = os.environ.get("QUILLON_REPORT", "full_analysis.json")
    key: str = os.environ.get("QUILLON_API_KEY", "")
    model: str = os.environ.get("QUILLON_MODEL", "")


def analyze_mails(mails: DataFrame, provider: Callable[[DataFrame], DataFrame] = by_rules, reader: Callable[[bytes], str] | None = None, ocr_provider: Callable[[DataFrame], DataFrame] | None = None, weights: dict[str, float] | None = None, key: str = "file") -> DataFrame:
    """One row per mail (key, subject, sender, html, images): aggregate_mails' columns.

    provider: blocks with content to answers; reader: an image's bytes to its text; ocr_provider: rows of content (the
    assembled image text of a mail) to answers. Mails without image text are never sent to it.
    """
    scored = score_blocks(provider(blocks(mails, key)), weights)
    if reader is None:
        return aggregate_mails(scored, key)
    read = read_images(mails, reader, key).withColumn("content", ocr_text(F.col("results")))
    if ocr_provider is None:
        ocr = read.select(key, "results", F.lit(0.0).alias("ocr_probability"), F.array().cast("array<string>").alias("flags"), F.lit("").alias("summary"))
    else:
        with_text, without = read.where(has_ocr_text(F.col("results"))), read.where(~has_ocr_text(F.col("results")))
        asked = ocr_provider(with_text).select(key, "results", S.normalize_probability(F.col("ai_probability")).alias("ocr_probability"), "flags", "summary")
        ocr = asked.unionByName(without.select(key, "results", F.lit(0.0).alias("ocr_probability"), F.array().cast("array<string>").alias("flags"), F.lit("").alias("summary")))
    return aggregate_mails(scored, key, ocr)


def process_directory(spark: SparkSession, folder: str, report: str | None = None, **how) -> int:
    """Analyses all mails of a folder and writes the full report; the number of mails."""
    mails = read_mails(spark, folder)
    entries = report_entries(mails, analyze_mails(mails, **how))
    return write_full_report(entries, report) if report else entries.count()
