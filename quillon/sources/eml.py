"""Mails in a folder of .eml files: the scan is binaryFile, the MIME parse one Arrow pass over the contents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from email import policy
from email.parser import BytesParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.images import data_uri_images
from quillon.operators.mails import drop_rule

NO_SUBJECT, NO_SENDER = "Без темы", "Неизвестный отправитель"
BATCH_BYTES, SHARE = 4 << 20, 64
PARSED = "file string, subject string, sender string, html string, images array<struct<source: string, bytes: binary, content_id: string>>, error string"


def clean(s: str) -> str:
    """Without lone surrogates, which no column can hold."""
    return s.encode("utf-8", errors="ignore").decode("utf-8")


def repair(header: str) -> str:
    """UTF-8 that was read as Latin-1, read again; anything else as it is."""
    try:
        return header.encode("latin-1").decode("utf-8")
    except UnicodeError:
        return clean(header)


def _body(msg) -> str:
    html = None
    if msg.is_multipart():
        html = next((p for p in msg.walk() if p.get_content_type() == "text/html"), None)
    elif msg.get_content_type() == "text/html":
        html = msg
    text = html.get_content() if html is not None else ""
    if text:
        return text
    try:
        best = msg.get_body(("plain",))
        text = best.get_content()
    except Exception:
        text = ""
    return text


def _images(msg) -> list[dict]:
    out = []
    for part in msg.walk():
        kind = part.get_content_type()
        if not kind.startswith("image/"):
            continue
        try:
            if payload := part.get_payload(decode=True):
                cid = part.get("Content-ID")
                out.append({"source": clean(str(part.get_filename() or cid or kind)), "bytes": payload, "content_id": None if cid is None else clean(str(cid))})
        except Exception:
            continue
    return out


def parse_mail(content: bytes) -> dict:
    """subject, sender, html, images of the MIME parts; or error."""
    try:
        msg = BytesParser(policy=policy.default).parsebytes(content)
        return {"subject": repair(str(msg.get("Subject", NO_SUBJECT))), "sender": repair(str(msg.get("From", NO_SENDER))), "html": clean(_body(msg)), "images": _images(msg), "error": None}
    except Exception as e:
        return {"subject": None, "sender": None, "html": None, "images": [], "error": f"{type(e).__name__}: {e}"[:200]}


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("source", pa.string()), ("bytes", pa.binary()), ("content_id", pa.string())]))
    names = ["file", "subject", "sender", "html", "images", "error"]
    kinds = [pa.string()] * 4 + [kind, pa.string()]

    def out(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    rows, size = [], 0
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            raw = content.as_buffer().to_pybytes() if content.is_valid else b""
            rows.append(parse_mail(raw) | {"file": re.sub(r".*/", "", path.as_py() or "")})
            size += len(raw)
            # mails are of any size
            if size > BATCH_BYTES or len(rows) >= 1024:
                yield out(rows)
                rows, size = [], 0
    if rows:
        yield out(rows)


def parse_files(files: DataFrame) -> DataFrame:
    """path, content (binaryFile rows) to parsed mails with the images of body data URIs after those of MIME parts."""
    m = files.select("path", "content").mapInArrow(_parse, PARSED)
    uris = F.transform(data_uri_images(F.col("html")), lambda b, i: F.struct(F.concat(F.lit("data_uri_"), i.cast("string")).alias("source"), b.alias("bytes"), F.lit(None).cast("string").alias("content_id")))
    return m.withColumn("images", F.concat("images", F.coalesce(uris, F.array().cast("array<struct<source:string,bytes:binary,content_id:string>>"))))


def read_mails(spark: SparkSession, folder: str, partitions: int | None = None, keep_errors: bool = False) -> DataFrame:
    """file, subject, sender, html, images of every *.eml directly in the folder; an empty folder gives no rows.

    Mails that don't parse, or have neither body nor image, are left out; keep_errors returns all, with error set.
    A task reads many files, of which there are SHARE tasks a core at most; partitions spreads a few large ones by a shuffle instead.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(folder)
    parsed = parse_files(files.repartition(partitions) if partitions else files.coalesce(SHARE * spark.sparkContext.defaultParallelism))
    return parsed if keep_errors else drop_rule(parsed.where("error is null")).drop("error")
