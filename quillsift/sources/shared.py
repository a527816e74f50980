"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one where that is unset and the master is local."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if root:
        return root
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="quillsift-")


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder; it is deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"

    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def kept(df: DataFrame, what: str) -> DataFrame:
    """df as a written table: what several branches read is worked out once, and nothing stays cached afterwards."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete what kept() has written for these frames; nothing may read them any more."""
    for df in frames:
        if folder := getattr(df, "_folder", None):
            remove(df.sparkSession, folder)
