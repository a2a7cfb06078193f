"""A library as shards of numbered rows with manifests, a catalog over them, companions, and readers by global id.

A shard is a Parquet folder whose rows have consecutive global ids; its manifest, written last, has its range, its numbers and
a digest of its rows. A catalog is valid if its shards are of one library, hold what their manifests say, and cover the ids
from 0 on without gap or overlap. A companion table has more columns for the same rows, told by gid, molecule and conformer.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnrank.operators.ranking import ranked_globally
from cairnrank.operators.records import catalog_faults
from cairnrank.plans.receipts import canonical_hash, digest

IDENTITY = ["gid", "molecule", "conformer"]
_MANIFEST = "library_id string, name string, start bigint, conformers bigint, features bigint, digest string"


@dataclass(frozen=True)
class Catalog:
    root: str
    library_id: str
    shards: tuple[dict, ...]

    @property
    def conformers(self) -> int:
        return sum(s["conformers"] for s in self.shards)

    @property
    def features(self) -> int:
        return sum(s["features"] for s in self.shards)

    @property
    def hash(self) -> str:
        return canonical_hash([self.library_id, *self.shards])


def write_shard(rows: DataFrame, root: str, name: str, library_id: str, start: int) -> dict:
    """Number rows (molecule, conformer, features array, ..) from ``start`` by molecule and conformer and write them.

    A shard that is there already must hold the same rows; then nothing is written. Numbers need no single task.
    """
    spark, folder = rows.sparkSession, f"{root.rstrip('/')}/{name}"
    numbered = ranked_globally(rows, [F.asc("molecule"), F.asc("conformer")]).withColumn("gid", F.col("rank") + F.lit(start - 1)).drop("rank")
    numbered = numbered.select("gid", *rows.columns)
    counts = numbered.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("features")), F.lit(0)).alias("f"), F.countDistinct("molecule", "conformer").alias("d")).first()
    if counts["n"] != counts["d"]:
        raise ValueError(f"{name}: rows repeat a molecule's conformer, or have none")
    line = {"library_id": library_id, "name": name, "start": start, "conformers": counts["n"], "features": counts["f"], "digest": digest(numbered)}
    if (there := next((m for m in manifests(spark, root) if m["name"] == name), None)) is not None:
        if there != line:
            raise ValueError(f"{name} holds other rows")
        return there
    numbered.write.mode("overwrite").parquet(f"{folder}/rows")
    spark.createDataFrame([(json.dumps(line, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return line


def manifests(spark: SparkSession, root: str) -> list[dict]:
    """The manifests under a root, by first id: one line a shard."""
    try:
        lines = spark.read.text(f"{root.rstrip('/')}/*/manifest").collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    return sorted((json.loads(r["value"]) for r in lines if r["value"]), key=lambda m: (m["start"], m["name"]))


def open_catalog(spark: SparkSession, root: str, library_id: str, verify: bool = True) -> Catalog:
    """The catalog of all shards under a root; what makes it invalid is an error. ``verify``: read the rows and check digests."""
    found = manifests(spark, root)
    if not found:
        raise ValueError(f"no shards under {root}")
    if other := [m["name"] for m in found if m["library_id"] != library_id]:
        raise ValueError(f"shards of another library: {other}")
    table = spark.createDataFrame([(m["name"], m["start"], m["conformers"]) for m in found], "shard string, start bigint, count bigint")
    if faults := [r["shard"] for r in catalog_faults(table).collect()]:
        raise ValueError(f"ids overlap or have a gap at {faults}")
    for m in found if verify else []:
        rows = _shard(spark, root, m)
        if digest(rows) != m["digest"] or rows.filter((F.col("gid") < m["start"]) | (F.col("gid") >= m["start"] + m["conformers"])).limit(1).count():
            raise ValueError(f"{m['name']} does not hold what its manifest says")
    return Catalog(root.rstrip("/"), library_id, tuple(found))


def _shard(spark: SparkSession, root: str, manifest: dict) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{manifest['name']}/rows")


def read(spark: SparkSession, catalog: Catalog, columns: list[str] | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """Rows of the catalog, or those with ids in [low, high), whose shards alone are read; ``columns``: these besides gid.

    With columns of features alone this is the light reader: others are never read.
    """
    low, high = 0 if low is None else low, catalog.conformers if high is None else high
    if not 0 <= low <= high <= catalog.conformers:
        raise ValueError(f"ids [{low}, {high}) are not all in the catalog")
    shards = [s for s in catalog.shards if s["start"] < high and s["start"] + s["conformers"] > low] or list(catalog.shards[:1])
    rows = spark.read.parquet(*[f"{catalog.root}/{s['name']}/rows" for s in shards]).filter((F.col("gid") >= low) & (F.col("gid") < high))
    return rows if columns is None else rows.select("gid", *[c for c in columns if c != "gid"])


def get(spark: SparkSession, catalog: Catalog, wanted: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows for wanted ids (place, gid), repeats included; an id that the catalog has not is an error.

    The wanted range prunes shards and row groups; the ids meet the rows in one join.
    """
    edge = wanted.agg(F.min("gid").alias("a"), F.max("gid").alias("b"), F.count_if(F.col("gid").isNull()).alias("none")).first()
    if edge["none"]:
        raise ValueError("an id is null")
    if edge["a"] is None:
        return wanted.join(read(spark, catalog, columns, 0, 0), "gid")
    if edge["a"] < 0 or edge["b"] >= catalog.conformers:
        raise ValueError(f"ids {edge['a']} to {edge['b']} are not all in the catalog")
    return wanted.join(read(spark, catalog, columns, edge["a"], edge["b"] + 1), "gid")


def identity_faults(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Ids whose molecule and conformer differ between two tables, or that one of them lacks: gid, reason. None if they agree."""
    gid, *rest = keys or IDENTITY
    left = a.select(F.col(gid).alias("gid"), F.struct(*rest).alias("x"))
    both = left.join(b.select(F.col(gid).alias("gid"), F.struct(*rest).alias("y")), "gid", "full")
    reason = F.when(F.col("x").isNull(), "missing in the first").when(F.col("y").isNull(), "missing in the second").when(~F.col("x").eqNullSafe(F.col("y")), "another row")
    return both.select("gid", reason.alias("reason")).filter("reason is not null")


def with_companion(rows: DataFrame, companion: DataFrame) -> DataFrame:
    """Rows with their companion's columns; a companion row of another molecule or conformer, or none, is an error."""
    own = companion.select(F.col("gid"), F.struct(*IDENTITY[1:]).alias("_of"), *[c for c in companion.columns if c not in IDENTITY])
    both = rows.join(own, "gid", "left")
    same = F.col("_of").eqNullSafe(F.struct(*[F.col(c) for c in IDENTITY[1:]]))
    checked = F.when(same, F.col("gid")).otherwise(F.raise_error(F.concat(F.lit("no companion of the same identity: "), F.col("gid").cast("string"))).cast("bigint"))
    return both.withColumn("gid", checked).drop("_of")
