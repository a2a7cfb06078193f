"""Records and their registry: summaries, idempotent import, conflicts, states, catalogs and equivalence checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def library_summary(conformers: DataFrame, library: str, molecule: str, size: str) -> DataFrame:
    """By library: molecules, conformers, and the sum of sizes (0 if there are none)."""
    return conformers.groupBy(library).agg(F.countDistinct(molecule).alias("molecules"), F.count(molecule).alias("conformers"), F.coalesce(F.sum(size), F.lit(0)).alias("total"))


def group_size_histogram(rows: DataFrame, molecule: str) -> DataFrame:
    return rows.groupBy(molecule).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("molecules"))


def imported(records: DataFrame, known: DataFrame, keys: list[str], digest: str, order: list[str]) -> DataFrame:
    """Outcome of each record: ``inserted``, ``duplicate`` (digest known, or earlier in this import) or ``conflict``.

    A conflict is another digest for keys that are known or come earlier. The first record of a key is found by a hash
    aggregate with map-side minima, so one key may have most of the rows. ``order`` names a record.
    """
    at = F.struct(*order)
    first = records.groupBy(*keys).agg(F.min(F.struct(at.alias("at"), F.col(digest).alias("digest"))).alias("_first"))
    first = first.join(known.groupBy(*keys).agg(F.min(digest).alias("_known")), keys, "left")
    rows = records.join(first, keys)
    outcome = F.when(F.col(digest) != F.coalesce("_known", "_first.digest"), "conflict").when(F.col("_known").isNotNull() | (at != F.col("_first.at")), "duplicate")
    return rows.withColumn("outcome", outcome.otherwise("inserted")).drop("_first", "_known")


def preserved_index(rows: DataFrame, molecule: str, index: str, order: list[str]) -> DataFrame:
    """Indexes that repeat within a molecule become -1, -2, ... in order; the first keeps its own."""
    n = F.row_number().over(Window.partitionBy(molecule, index).orderBy(*order))
    rows = rows.withColumn("_n", n)
    late = F.sum(F.when(F.col("_n") > 1, 1).otherwise(0)).over(Window.partitionBy(molecule).orderBy(*order))
    return rows.withColumn("internal_index", F.when(F.col("_n") == 1, F.col(index).cast("bigint")).otherwise(-late)).drop("_n")


def illegal_transitions(events: DataFrame, entity: str, state: str, order: list[str], legal: dict[str, tuple[str, ...]], start: tuple[str, ...]) -> DataFrame:
    """Events that their entity's state before them doesn't allow."""
    before = F.lag(state).over(Window.partitionBy(entity).orderBy(*order))
    ok = F.lit(False)
    for a, bs in legal.items():
        ok = ok | ((F.col("before") == a) & F.col(state).isin(*bs))
    fine = F.when(F.col("before").isNull(), F.col(state).isin(*start)).otherwise(ok)
    return events.withColumn("before", before).filter(~fine)


def catalog_faults(shards: DataFrame, start: str = "start", count: str = "count", order: str = "start") -> DataFrame:
    """Shards that don't begin where the one before ends (the first: at 0)."""
    w = Window.orderBy(order)
    expected = F.coalesce(F.lag(F.col(start) + F.col(count)).over(w), F.lit(0))
    return shards.withColumn("expected", expected).filter(F.col(start) != F.col("expected"))


def score_equivalence(a: DataFrame, b: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Greatest score difference, and ids that only one side has."""
    both = a.select(*keys, F.col(score).alias("sa")).join(b.select(*keys, F.col(score).alias("sb")), keys, "full")
    return both.agg(
        F.coalesce(F.max(F.abs(F.col("sa") - F.col("sb"))), F.lit(0.0)).alias("max_error"),
        F.count_if(F.col("sa").isNull()).alias("only_second"), F.count_if(F.col("sb").isNull()).alias("only_first"), F.count("*").alias("ids"),
    )


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same rows, as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def settings_summary(runs: DataFrame, by: list[str], value: str, gate: float) -> DataFrame:
    """By setting: runs, least and mean value, median and 95th percentile, and whether the least passes the gate."""
    out = runs.groupBy(*by).agg(F.count("*").alias("runs"), F.min(value).alias("least"), F.avg(value).alias("mean"), F.percentile(value, F.array(F.lit(0.5), F.lit(0.95))).alias("p"))
    return out.select(*by, "runs", "least", "mean", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), (F.col("least") >= gate).alias("passes"))


def hashed_sample(rows: DataFrame, n: int, gid: str = "gid", seed: int = 49) -> DataFrame:
    """``n`` rows by hashed id: the same on every run."""
    return rows.orderBy(F.xxhash64(F.col(gid), F.lit(seed)), gid).limit(n)


def stratified_counts(shards: DataFrame, n: int, shard: str = "shard", size: str = "size") -> DataFrame:
    """Largest-remainder shares of ``n`` by size, one at least for each shard."""
    whole = Window.partitionBy()
    share = F.col(size) * (F.lit(n) - F.count("*").over(whole)) / F.sum(size).over(whole)
    rows = shards.withColumns({"floor": F.floor(share), "part": share - F.floor(share)})
    left = F.lit(n) - F.count("*").over(whole) - F.sum("floor").over(whole)
    place = F.row_number().over(Window.orderBy(F.desc("part"), F.asc(shard)))
    return rows.withColumn("take", (1 + F.col("floor") + F.when(place <= left, 1).otherwise(0)).cast("bigint")).select(shard, "take")
