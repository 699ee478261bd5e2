"""Tables and lineage cuts in the folder that a cluster's machines share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from spark.checkpoint.dir; a temporary one only where that is unset, and never on a cluster."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        where = tempfile.mkdtemp(prefix="quillon-checkpoint-")
    sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def fresh(spark: SparkSession) -> str:
    """Name of a folder of one's own in the cluster's shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/quillon-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder in the cluster's shared folder, gone afterwards: what comes of its tables must be cut before."""
    where = fresh(spark)
    try:
        yield where
    finally:
        remove(spark, where)


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """A table in the cluster's shared folder, or in a scratch folder there: written once, then read by several later jobs."""
    where = f"{folder or ensure_checkpoint_dir(df.sparkSession)}/quillon-{uuid.uuid4().hex}"
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
