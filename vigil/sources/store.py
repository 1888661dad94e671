"""Cutting lineage where a plan reads one frame many times."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
#: Spark then deletes a query's shuffle files when it ends, instead of when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame) -> DataFrame:
    """df written to the cluster's shared checkpoint folder and read again. The shuffle files of the write go with it."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root is None and re.match(r"local(\[|$)", spark.sparkContext.master):
        root = tempfile.gettempdir()  # one process: its folder is shared by all tasks
    if root is None:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{root.rstrip('/')}/frame-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*frames: DataFrame) -> None:
    """Deletes stored frames that nothing reads any more."""
    for df in frames:
        for path in [p for p in _written if any(f"/{p.rsplit('/', 1)[1]}/" in f for f in df.inputFiles()[:1])]:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
            _written.remove(path)


def clear(spark: SparkSession) -> int:
    """Deletes the tables that this process has stored so far: for long sessions, once the frames that read them are no longer used."""
    n = len(_written)
    for path in _written:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _written.clear()
    return n
