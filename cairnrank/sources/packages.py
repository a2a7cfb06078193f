"""Query packages, chunks of a stage with receipts, snapshots of sources, and digests of files.

A package or chunk is a Parquet folder and a receipt, written last, with a digest of the rows; reading one whose rows have
another digest is an error. Files are digested where they are read; only their names and digests reach the driver.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnrank.plans.receipts import canonical_hash, digest

_QUERY = {
    "shape": "array<array<double>>", "features": "array<array<double>>", "types": "array<int>", "directions": "array<array<double>>", "kinds": "array<int>",
    "weights": "array<double>", "anchors": "array<int>",
}


def _write_line(spark: SparkSession, line: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(line, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_line(spark: SparkSession, path: str) -> dict:
    lines = [r["value"] for r in spark.read.text(path).limit(2).collect()]
    if len(lines) != 1:
        raise ValueError(f"{path} is no receipt")
    return json.loads(lines[0])


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def query_faults(rows: DataFrame) -> DataFrame:
    """Why queries can't be used, the first reason of each: query_id, reason.

    A query has points and features of three finite numbers, for each feature a type, a weight of 0 or more, a kind of 0, 1 or 2
    and a direction, of length 1 (within 0.005) where its kind isn't 0, and anchors that are places of features.
    """
    n = F.size("features")
    point = lambda p: (F.size(p) == 3) & F.forall(p, _finite)
    length = lambda d: F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, v: s + v * v))
    straight = F.forall(F.arrays_zip("directions", "kinds"), lambda p: (p["kinds"] == 0) | (F.abs(length(p["directions"]) - 1) <= 5e-3))
    rules = [
        ("shape", (F.size("shape") > 0) & F.forall("shape", point)), ("features", (n > 0) & F.forall("features", point)), ("lengths", (F.size("types") == n) & (F.size("weights") == n)),
        ("weights", F.forall("weights", lambda w: _finite(w) & (w >= 0))), ("directions", (F.size("directions") == n) & F.forall("directions", point)),
        ("kinds", (F.size("kinds") == n) & F.forall("kinds", lambda k: k.isin(0, 1, 2))), ("unit directions", straight), ("anchors", F.forall("anchors", lambda a: (a >= 0) & (a < n))),
    ]
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules])
    return rows.select("query_id", reason.alias("reason")).filter("reason is not null")


def write_queries(rows: DataFrame, folder: str) -> dict:
    """Write queries (query_id and the columns of a package; directions and kinds may be absent: none); a fault is an error."""
    n = F.size("features")
    if "directions" not in rows.columns:
        rows = rows.withColumns({"directions": F.array_repeat(F.array(*[F.lit(0.0)] * 3), n), "kinds": F.array_repeat(F.lit(0), n)})
    rows = rows.select("query_id", *[F.col(c).cast(t).alias(c) for c, t in _QUERY.items()]).withColumn("anchors", F.array_sort(F.array_distinct("anchors")))
    if found := query_faults(rows).limit(5).collect():
        raise ValueError(f"queries with faults: {[tuple(r) for r in found]}")
    rows.write.mode("overwrite").parquet(f"{folder}/rows")
    line = {"format": "query-package", "version": 1, "digest": digest(rows.sparkSession.read.parquet(f"{folder}/rows"))}
    _write_line(rows.sparkSession, line, f"{folder}/receipt")
    return line


def load_queries(spark: SparkSession, folder: str) -> DataFrame:
    line, rows = _read_line(spark, f"{folder}/receipt"), spark.read.parquet(f"{folder}/rows")
    if (line.get("format"), line.get("version")) != ("query-package", 1) or digest(rows) != line["digest"]:
        raise ValueError(f"{folder} does not hold the queries of its receipt")
    return rows


def write_chunk(rows: DataFrame, folder: str, stage: str, number: int, start: int, stop: int, parameters: dict) -> dict:
    """Rows (gid, ..) of places [start, stop) of a stage's work, one each, under stage=/chunk=, with a receipt."""
    path = f"{folder}/stage={stage}/chunk={number}"
    ids = rows.select("gid")
    if (n := rows.count()) != stop - start or ids.distinct().count() != n:
        raise ValueError(f"{path}: {n} rows for {stop - start} places, or an id repeats")
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    held = rows.sparkSession.read.parquet(f"{path}/rows")
    line = {"stage": stage, "chunk": number, "start": start, "stop": stop, "parameters": canonical_hash(parameters), "ids": digest(held.select("gid")), "digest": digest(held)}
    _write_line(rows.sparkSession, line, f"{path}/receipt")
    return line


def verify_chunk(spark: SparkSession, folder: str, stage: str, number: int, start: int, stop: int, parameters: dict, stages: int | None = None) -> DataFrame:
    """A chunk's rows; another range, other parameters or rows, or a column ``stage_level`` over ``stages`` is an error."""
    path = f"{folder}/stage={stage}/chunk={number}"
    line, rows = _read_line(spark, f"{path}/receipt"), spark.read.parquet(f"{path}/rows")
    if (line["start"], line["stop"], line["parameters"]) != (start, stop, canonical_hash(parameters)):
        raise ValueError(f"{path} is another piece of work")
    if digest(rows) != line["digest"]:
        raise ValueError(f"{path} does not hold the rows of its receipt")
    if stages is not None and not rows.filter(F.coalesce((F.col("stage_level") < 0) | (F.col("stage_level") > stages), F.lit(True))).isEmpty():
        raise ValueError(f"{path} has a stage beyond {stages}")
    return rows


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, bytes, sha256 of files of less than 2 GB each, hashed in the tasks that read them; files without a byte have no row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def folder_hash(spark: SparkSession, path: str, pattern: str = "*") -> str:
    """One digest of a folder's files by name and content; moving the folder doesn't change it."""
    rows = file_hashes(spark, path, pattern).select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")
    return digest(rows)


def snapshot(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, bytes and time of change of files, without reading them; files without a byte have no row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("changed"))


def changed_since(before: DataFrame, now: DataFrame) -> DataFrame:
    """Files that a snapshot has otherwise, no more, or not yet: path, reason."""
    a, b = (s.select("path", F.struct("bytes", "changed").alias(n)) for s, n in ((before, "a"), (now, "b")))
    reason = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "path", "full").select("path", reason.alias("reason")).filter("reason is not null")


def decoded_ids(rows: DataFrame, column: str) -> DataFrame:
    """Ids of bytes as text; one that is empty, has a NUL or isn't UTF-8 is an error."""
    text = F.decode(F.col(column), "UTF-8")
    ok = (F.length(text) > 0) & ~F.contains(text, F.lit("\0")) & (F.encode(text, "UTF-8") == F.col(column))
    return rows.withColumn(column, F.when(F.coalesce(ok, F.lit(False)), text).otherwise(F.raise_error(F.lit(f"{column}: not an id"))))


def write_vectors(rows: DataFrame, path: str, width: int) -> None:
    """(id, vector) as Parquet of floats; a vector of another width, or no rows, is an error."""
    if rows.isEmpty():
        raise ValueError("there are no vectors")
    own = F.when(F.size("vector") == width, F.col("vector")).otherwise(F.raise_error(F.lit(f"a vector has not {width} numbers")))
    rows.select("id", own.cast("array<float>").alias("vector")).write.parquet(path)


def write_json(value: object, path: str | Path) -> None:
    """A small value as JSON with sorted keys on the driver's disk: written beside the target, then put in its place."""
    target = Path(path)
    beside = target.with_name(target.name + ".part")
    beside.write_text(json.dumps(value, sort_keys=True, indent=2, allow_nan=False) + "\n", encoding="utf-8")
    beside.replace(target)
