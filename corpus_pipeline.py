"""A training-corpus pipeline over the documents table: filter, deduplicate, decontaminate, mix.

Every stage works on all that its predecessor kept. All but the last return the columns of documents; the last
returns the reading order (doc_id, source, rank, block, release, deadline, slot, place).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontamination, linededup, mixing, neardedup, quality
from quillon.llm.common import table
from quillon.sources.shared import fresh, remove, stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on those labelled as good, doesn't reject."""
    return quality.quality_filter(docs, quality.trusted_of(table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that three or more share but in the last of them."""
    return linededup.line_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardedup.near_dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The reading order of all documents that are left, sources at the square roots of their sizes."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
]

#: The language model's probabilities can't be had in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            folder = fresh(spark)
            docs = stored(docs, folder)
            # all that the stage before left is in this table now
            if before:
                remove(spark, before)
            before = folder
    return docs
