"""Session helpers: the shared scratch folder, staged tables and code shipping."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Rows of whole texts in an Arrow batch and in a batch of the Parquet reader, at most: they are large, and each task holds
#: a few batches, whose arrays the reader doubles as they fill.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.parquet.columnarReaderBatchSize": 512}
_used: set[str] = set()
REPO = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever the driver was started."""
    env = spark.sparkContext.environment
    parts = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if REPO not in parts:
        env["PYTHONPATH"] = os.pathsep.join([REPO, *filter(None, parts)])
    for name, rows in BATCHES.items():
        if int(spark.conf.get(name)) > rows:
            spark.conf.set(name, rows)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where it is unset and all runs on one machine."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="cairnrank-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, in this application's part of it, which goes when the driver ends."""
    folder = f"{shared_folder(spark)}/cairnrank/{spark.sparkContext.applicationId}"
    if folder not in _used:
        if not _used:
            atexit.register(_clear_all)
        _used.add(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete what this application has staged; DataFrames over it can't be read any more."""
    for folder in list(_used):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _used.discard(folder)


def _clear_all() -> None:
    if SparkContext._active_spark_context is not None and (spark := SparkSession.getActiveSession()) is not None:
        try:
            clear(spark)
        except Exception as e:  # the JVM may be gone by now
            print(f"cairnrank: staged tables stay in {sorted(_used)}: {e}")


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    writer = df.write.option("compression", "lz4")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
