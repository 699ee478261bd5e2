"""Reports: one JSON array of all mails, one JSON per mail, or tables."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.functions.text import clean_json_data, timestamp, truncate_text
from quillon.sources.shared import scratch


def report_entries(mails: DataFrame, analysis: DataFrame, key: str = "file") -> DataFrame:
    """key, email (subject, sender), analysis: a row of the full report.

    Both sides meet in ranges of the key, which is the order of the report, so that the texts are shuffled once and not for a join and for an order.
    """
    # ranges are found by going through the rows once more; mails may cost much to read, so they aren't read again
    m = mails.select(key, F.struct("subject", "sender").alias("email"), F.lit(None).alias("analysis")).repartition(key)
    a = analysis.select(key, F.lit(None).alias("email"), F.struct(*[c for c in analysis.columns if c != key]).alias("analysis"))
    both = m.unionByName(a).where(F.col(key).isNotNull()).repartitionByRange(key)
    # pairs of a key as an inner join has them
    pairs = both.groupBy(key).agg(F.collect_list("email").alias("email"), F.collect_list("analysis").alias("analysis"))
    return pairs.withColumn("email", F.explode("email")).withColumn("analysis", F.explode("analysis"))


def _indented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # all but the line end and the brace that close an entry, which are written as the end of a line
        texts = [",\n" + json.dumps(json.loads(j), indent=2, ensure_ascii=False)[:-2] for j in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["value"])


def write_full_report(entries: DataFrame, path: str, key: str = "file") -> int:
    """One indented JSON array, ordered by key, replacing the last one. No rows: nothing is written. The number of mails.

    The executors write the entries' text into the shared folder, a range of keys each; the driver appends the pieces' bytes and holds none of
    them. A path without a scheme is a file on the driver.
    """
    spark, seen = entries.sparkSession, Observation()
    rows = entries.orderBy(key).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
    with scratch(spark) as pieces:
        texts = rows.mapInArrow(_indented, "value string").observe(seen, F.count(F.lit(1)).alias("n"))
        texts.write.option("lineSep", "\n}").option("compression", "none").text(pieces)
        n = seen.get["n"]
        if n:
            _append(spark, pieces, path)
    return n


def _append(spark: SparkSession, pieces: str, path: str) -> None:
    """The pieces, in order of partitions, as one array at path. Each is removed once it is there, so that the text takes its room once."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    source, target = hadoop.fs.Path(pieces), hadoop.fs.Path(path if re.match(r"\w[\w+.-]*:/", path) else f"file://{os.path.abspath(path)}")
    fs, out_fs = source.getFileSystem(conf), target.getFileSystem(conf)
    if out_fs.getScheme() == "file":
        out_fs = out_fs.getRawFileSystem()  # no file of checksums beside it
    found = [x for x in fs.listStatus(source) if x.getPath().getName().startswith("part-") and x.getLen()]
    found = sorted(found, key=lambda x: (int(x.getPath().getName().split("-")[1]), x.getPath().getName()))
    part = target.suffix(".part")
    out = out_fs.create(part, True)
    out.write(bytearray(b"[\n"))
    for i, x in enumerate(found):
        piece = fs.open(x.getPath())
        piece.seek(0 if i else 2)  # the first entry follows none
        hadoop.io.IOUtils.copyBytes(piece, out, 1 << 20, False)
        piece.close()
        fs.delete(x.getPath(), False)
    out.write(bytearray(b"\n]\n"))
    out.close()
    # some file systems don't rename onto a file
    if not (out_fs.rename(part, target) or (out_fs.delete(target, False) and out_fs.rename(part, target))):
        raise OSError(f"{part.toString()} can't be renamed to {target.toString()}")


def load_full_report(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of an array as write_full_report writes it, in a folder that all executors share; many tasks read one file.

    Only between two entries is there a line that is a brace alone and one that opens: all within an entry is indented, and strings hold no bare line break.
    """
    v = F.col("value")
    rest = F.when(v.startswith("[\n{\n"), F.expr("substring(value, 5)")).otherwise(v)
    rest = F.when(v.endswith("\n}\n]\n"), F.left(rest, F.char_length(rest) - 5)).otherwise(rest)
    entries = spark.read.option("lineSep", "\n},\n{\n").text(path)
    return entries.select(F.from_json(F.concat(F.lit("{"), rest, F.lit("}")), schema).alias("e")).select("e.*")


def save_json(df: DataFrame, path: str) -> None:
    """JSON lines in a folder, of df with all its strings cleaned."""
    df.select(*[clean_json_data(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def load_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Rows of a file that is one JSON array or object, or of a folder of JSON lines; without a schema, all is read once more to find it."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    first = next(iter(spark.read.text(path, wholetext=False).where("trim(value) <> ''").limit(1).collect()), [""])[0].strip()
    # one value over several lines, unless each line is whole
    lines = first.startswith("{") and first.endswith("}")
    return reader.option("multiLine", not lines).json(path)


def mail_reports(mails: DataFrame, analysis: DataFrame, key: str = "file") -> DataFrame:
    """key, timestamp, email (with a preview of the body), analysis (with a summary of the blocks)."""
    a = analysis.select(F.col(key).alias("q_key"), *[F.col(c) for c in analysis.columns if c != key])
    j = mails.select(key, "subject", "sender", "html").join(a, F.col(key) == F.col("q_key"))
    short = F.transform("blocks", lambda b: F.struct(b["position"].alias("position"), b["block_type"].alias("block_type"), b["ai_score"].alias("ai_score"), b["flags"].alias("flags")))
    return j.select(
        key,
        timestamp().alias("timestamp"),
        F.struct("subject", "sender", truncate_text(F.col("html")).alias("html_preview")).alias("email"),
        F.struct("html_ai_score", "ocr_ai_score", "global_ai_score", "verdict", "engine", short.alias("blocks_summary"), "global_flags", "high_risk_blocks", F.col("blocks").alias("blocks_details"), "ocr").alias("analysis"),
    )


def write_mail_reports(reports: DataFrame, path: str, key: str = "file") -> None:
    """JSON lines in one folder per mail, so that two mails of the same second don't collide."""
    reports.withColumn("mail", F.col(key)).write.mode("overwrite").partitionBy("mail").json(path)


def write_table(df: DataFrame, path: str, format: str = "parquet") -> None:
    df.write.mode("overwrite").format(format).save(path)
