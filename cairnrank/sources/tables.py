"""Loaders and sinks of ranked lists and ids with their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ids(spark: SparkSession, path: str, kind: str = "parquet", column: str = "gid") -> DataFrame:
    """Ids from parquet, json, csv or text as a bigint column ``gid``; anything but an integer of 0 or more is an error."""
    rows = spark.read.text(path).select(F.trim("value").alias("v")).filter("v <> ''") if kind == "text" else spark.read.format(kind).load(path).select(F.col(column).cast("string").alias("v"))
    ok = F.col("v").rlike(r"^\d+$")
    return rows.select(F.when(ok, F.col("v")).otherwise(F.raise_error(F.concat(F.lit("not an id: "), F.coalesce("v", F.lit("null"))))).cast("bigint").alias("gid"))


def distinct_ids(spark: SparkSession, path: str, kind: str = "parquet", column: str = "gid") -> DataFrame:
    return ids(spark, path, kind, column).distinct()


def repeated(rows: DataFrame, gid: str = "gid") -> DataFrame:
    """Ids that stand more than once."""
    return rows.groupBy(gid).agg(F.count("*").alias("times")).filter("times > 1")


def fetched(wanted: DataFrame, corpus: DataFrame, gid: str = "gid", place: str = "place") -> DataFrame:
    """Corpus rows for wanted ids, with their places; repeats and unknown ids stay."""
    return wanted.join(corpus, gid, "left").select(place, gid, *[c for c in corpus.columns if c != gid])


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One object a line, keys in order."""
    rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value")).write.text(path)


def write_partitioned(rows: DataFrame, path: str, by: str) -> None:
    """Parquet by a column's value, each value's rows in few files: what a reader prunes by."""
    rows.repartition(by).sortWithinPartitions(by).write.partitionBy(by).parquet(path)
