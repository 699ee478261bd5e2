"""The same analysis as files arrive: new mails of a folder, each analysed once, appended to a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillon.operators.mails import drop_rule
from quillon.plans.analyze import analyze_mails
from quillon.sources.eml import parse_files

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def watch_folder(spark: SparkSession, folder: str, out: str, checkpoint: str, analyze: Callable[[DataFrame], DataFrame] = analyze_mails, files_per_batch: int = 10_000, once: bool = False) -> StreamingQuery:
    """Starts a query that appends analyses to out; a batch that is run again after a failure replaces its own output."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", "*.eml").option("maxFilesPerTrigger", files_per_batch).load(folder)

    def batch(df: DataFrame, batch_id: int) -> None:
        mails = drop_rule(parse_files(df).where("error is null")).drop("error")
        analyze(mails).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
