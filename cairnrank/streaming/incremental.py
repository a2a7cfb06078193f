"""Incremental work: file streams that append new shards once, and running counts and best rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairnrank.session import scratch


def file_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files: int = 8) -> DataFrame:
    """New Parquet files of a folder, a bounded number a batch, under a fixed schema."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)


def drained(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str | None = None, mode: str = "append") -> str:
    """Run a stream over all that is there now, ``each`` batch by batch; the checkpoint's folder, to go on from later."""
    checkpoint = checkpoint or scratch(stream.sparkSession, "stream")
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return checkpoint


def appended(stream: DataFrame, target: str, key: str, checkpoint: str | None = None) -> str:
    """Append rows to a Parquet folder once: a batch writes a folder of its own number, which a repeated batch replaces.

    Within a batch a repeated key counts once; keys of former batches are left out by an anti join on the key alone.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key])
        if number:
            before = spark.read.parquet(target).filter(F.col("batch") < number).select(key)
            rows = rows.join(before, key, "left_anti")
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return drained(stream, each, checkpoint)


def running_masks(stream: DataFrame, molecule: str, mask: str) -> DataFrame:
    """Joined masks and rows by molecule, as they stand (update or complete mode)."""
    return stream.groupBy(molecule).agg(F.bit_or(mask).alias(mask), F.count("*").alias("rows"))


def running_best(stream: DataFrame, molecule: str, score: str, gid: str) -> DataFrame:
    """Best (score desc, id asc) row by molecule, as it stands."""
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(gid)).alias("g"))).alias("b")
    return stream.groupBy(molecule).agg(best).select(molecule, (-F.col("b.g")).alias(gid), F.col("b.s").alias(score))


def kept(stream: DataFrame, checkpoint: str | None = None) -> DataFrame:
    """The final rows of a running aggregate over all that is there now.

    Each batch writes the whole state to a folder of its own; the last one counts, so a repeated batch does no harm.
    """
    spark, path = stream.sparkSession, scratch(stream.sparkSession, "state")
    last = [-1]

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        last[0] = number

    drained(stream, each, checkpoint, "complete")
    return spark.read.parquet(f"{path}/{last[0]}") if last[0] >= 0 else spark.createDataFrame([], stream.schema)
