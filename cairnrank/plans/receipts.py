"""Stages that run once: a stage's rows count again only if its inputs' digest and its own are unchanged."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical_hash(value: object) -> str:
    """SHA-256 of a value as JSON with sorted keys and no spaces."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def digest(rows: DataFrame) -> str:
    """A digest of a table that doesn't depend on its order: rows, and sums of two hashes of each."""
    cols = [F.col(c) for c in sorted(rows.columns)]
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), *cols).cast("decimal(38,0)")).alias(f"h{seed}")
    r = rows.agg(F.count("*").alias("n"), part(0), part(1)).first()
    return canonical_hash([r["n"], str(r["h0"]), str(r["h1"]), sorted(rows.dtypes)])


def _receipt(spark: SparkSession, folder: str) -> dict | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/receipt")
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return None
    lines = [r["value"] for r in spark.read.text(f"{folder}/receipt").collect()]
    return json.loads(lines[0]) if lines else None


def checked_stage(folder: str, inputs: dict[str, DataFrame], parameters: dict, operation: Callable[[], DataFrame], spark: SparkSession) -> tuple[DataFrame, bool]:
    """The stage's rows, and whether they were there already.

    Other inputs or parameters than those of the receipt are an error (they need another folder), and so are rows that no
    longer have the receipt's digest, and inputs that change while the stage runs. The receipt is written last.
    """
    key = lambda: canonical_hash({"inputs": {k: digest(v) for k, v in inputs.items()}, "parameters": parameters})
    own, there = key(), _receipt(spark, folder)
    if there:
        if there["key"] != own:
            raise ValueError(f"{folder} holds a stage with other inputs or parameters")
        rows = spark.read.parquet(f"{folder}/rows")
        if digest(rows) != there["digest"]:
            raise ValueError(f"{folder}: the stage's rows have changed")
        return rows, True
    operation().write.mode("overwrite").parquet(f"{folder}/rows")
    if key() != own:
        raise ValueError("inputs changed while the stage ran")
    rows = spark.read.parquet(f"{folder}/rows")
    line = json.dumps({"key": own, "digest": digest(rows)})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/receipt")
    return rows, False


def unfinished(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work items without a finished row: what a resumed run still has to do."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")
