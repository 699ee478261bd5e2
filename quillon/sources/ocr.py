"""Text of images: a provider per way of reading them. Any failure reads as no text."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tesseract(languages: str = "rus+eng") -> Callable[[bytes], str]:
    """Reads with Tesseract, where its Python packages are installed."""

    def read(data: bytes) -> str:
        import pytesseract
        from PIL import Image

        image = Image.open(io.BytesIO(data))
        return pytesseract.image_to_string(image if image.mode in ("RGB", "L") else image.convert("RGB"), lang=languages).strip()

    return read


def read_images(mails: DataFrame, reader: Callable[[bytes], str], key: str = "file") -> DataFrame:
    """key, results: array of (source, text, has_text), one per image in order; mails without images aren't in it."""
    images = mails.select(key, F.posexplode("images").alias("i", "x")).select(F.col(key).cast("string").alias("k"), "i", F.coalesce("x.source", F.lit("unknown")).alias("source"), "x.bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for b in batch.column(3):
                try:
                    texts.append(reader(b.as_py()) or "")
                except Exception:
                    texts.append("")
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(texts, pa.string())], names=["k", "i", "source", "text"])

    read = images.mapInArrow(run, "k string, i int, source string, text string")
    one = F.struct("i", "source", "text", (F.col("text") != "").alias("has_text"))
    out = read.groupBy("k").agg(F.array_sort(F.collect_list(one)).alias("r"))
    return out.select(F.col("k").alias(key), F.transform("r", lambda r: F.struct(r["source"].alias("source"), r["text"].alias("text"), r["has_text"].alias("has_text"))).alias("results"))
