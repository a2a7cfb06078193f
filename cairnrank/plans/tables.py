"""The library's relations on the driver's tables: which column plays which part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid, molecule, vector) of embeddings."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("gid"), F.col("label").cast("bigint").alias("molecule"), F.col("embedding").cast("array<double>").alias("vector"))


def asked(rows: DataFrame) -> DataFrame:
    """The stated query set: rows whose id is divisible by 20."""
    return rows.filter(F.col("gid") % 20 == 0)


def bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid, molecule = gid, vector): two 32-bit words, bit j set where dimension j is positive."""
    e = table(spark, sf_dir, "embeddings")
    word = lambda low: F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("bigint"), lambda w, j: w + F.when(F.col("embedding")[j + low] > 0, F.pow(F.lit(2.0), j).cast("bigint")).otherwise(0))
    return e.select(F.col("vec_id").alias("gid"), F.col("vec_id").alias("molecule"), F.array(word(0), word(32)).alias("vector"))


def clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid, idx, type, x, y, z): 21 features of each vector, at ten times its dimensions 3i to 3i + 2."""
    v = vectors(spark, sf_dir)
    at = lambda k: F.round(10 * F.col("vector")[3 * F.col("idx").cast("int") + k], 4)
    rows = v.select("gid", "vector", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("idx"))
    return rows.select("gid", F.col("idx").cast("bigint").alias("idx"), (F.col("idx") % 6 + 1).cast("bigint").alias("type"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site_id, query_id, receptor_id, molecule_id, gid, score): line items, asked by suppliers of nations."""
    rows, suppliers = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    rows = rows.join(suppliers.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return rows.select(
        F.col("s_nationkey").cast("string").alias("site_id"), F.col("l_suppkey").cast("string").alias("query_id"), F.concat(F.lit("R"), F.col("l_suppkey") % 7).alias("receptor_id"),
        F.col("l_partkey").alias("molecule_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("gid"), F.col("l_extendedprice").alias("score"),
    )


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid, molecule, score, scores, assignments, mask, stage): line items with four conditions each."""
    rows = table(spark, sf_dir, "lineitem")
    hits = [F.col("l_quantity") >= 25, F.col("l_discount") >= 0.05, F.col("l_tax") <= 0.04, F.col("l_returnflag") == "R"]
    from cairnrank.functions.scalars import mask_of
    from cairnrank.operators.masks import stage_level

    return rows.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("gid"), F.col("l_orderkey").alias("molecule"), F.col("l_extendedprice").alias("score"),
        F.array((F.col("l_quantity") / 50).alias("a"), F.col("l_discount") * 10, F.col("l_tax") * 12.5).alias("scores"),
        F.array(F.col("l_linenumber").cast("bigint"), F.when(F.col("l_linestatus") == "O", 1).otherwise(-1).cast("bigint"), F.lit(0).cast("bigint")).alias("assignments"),
        mask_of(hits).alias("mask"), stage_level(hits).alias("stage"), *[h.alias(f"h{j}") for j, h in enumerate(hits)],
    )
