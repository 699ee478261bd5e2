"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.shared import cut, scratch, stored  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space as the operators understand it.
BLANKS = " \t\n\x0b\x0c\r"
#: Everything that cannot be part of an alphanumeric word, after A-Z were lower-cased.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A side of a join is broadcast only if a count has shown it to have at most this many rows.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else; pure ASCII takes the fast path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column) -> Column:
    """Array of the alphanumeric words of a text (null: no words)."""
    low = ascii_lower(F.coalesce(c, F.lit("")))
    return F.filter(F.split(low, NOT_WORD, -1), lambda x: x != "")


def small_enough(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a side for broadcast after checking its size; beyond the limit the join stays a shuffle join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def packed(docs: DataFrame) -> DataFrame:
    """q_row, the whole row, beside doc_id: whatever else docs' columns are called, they can't clash. The text is q_row.text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("q_row"), F.col("doc_id"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows in gone (doc_id and th, the xxhash64 of the text); columns as in docs. Rows with a null doc_id stay."""
    rows = gone.select(F.col("doc_id").alias("q_gone"), F.col("th").alias("q_th")).where("q_gone is not null").distinct()
    here = packed(docs).withColumn("q_hash", F.xxhash64("q_row.text"))
    return here.join(small_enough(rows), (F.col("doc_id") == F.col("q_gone")) & (F.col("q_hash") == F.col("q_th")), "left_anti").select("q_row.*")
