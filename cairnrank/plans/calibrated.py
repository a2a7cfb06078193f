"""Calibrated search: settings of an index by recall, the least that passes, its candidates, their poses, their annotation."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnrank.functions import geometry as G
from cairnrank.operators import overlay, registry, vectors
from cairnrank.operators.ranking import union_of_tops
from cairnrank.session import staged


def sweep(index: DataFrame, queries: DataFrame, c: np.ndarray, settings: tuple[int, ...], k: int, truth: DataFrame) -> DataFrame:
    """Recall of each query at each number of probed lists: query_id, probes, strict and tied recall.

    ``truth``: exact ``vectors.nearest`` of the same k. Each setting reads the lists it probes, once for all queries.
    """
    rows = [vectors.recall(truth, vectors.probe(index, queries, c, p, k), k).withColumn("probes", F.lit(p)) for p in settings]
    return reduce(DataFrame.unionByName, rows)


def chosen(runs: DataFrame, queries: int, gate: float = 0.95) -> int | None:
    """The least setting at which every query has a strict recall of ``gate`` or more; None if no setting has."""
    return registry.chosen_setting(runs, "probes", "strict", queries, gate).first()["probes"]


def candidates(index: DataFrame, corpus: DataFrame, queries: DataFrame, c: np.ndarray, probes: int | None, budget: int, reuse: DataFrame | None = None) -> DataFrame:
    """(query_id, gid, molecule, value, rank): reused as they are, by the index at ``probes``, or by exact search where it is None."""
    if reuse is not None:
        return reuse
    return vectors.nearest(corpus, queries, budget) if probes is None else vectors.probe(index, queries, c, probes, budget)


def pose_stages(rows: DataFrame, retrieved: DataFrame, queries: dict[int, G.Overlay], anchors: dict[int, tuple], top_n: int, **seeding) -> tuple[DataFrame, DataFrame]:
    """Poses of each query's own candidates, coarse then fine, and what meets which anchor: both staged.

    Slim coarse scores alone cross the shuffle that chooses; shapes are read again for what is chosen.
    """
    own = rows.join(retrieved.select("query_id", "gid"), "gid")
    coarse = staged(overlay.scored(own, queries, poses=False, most=0), "coarse")
    top = union_of_tops(coarse, list(G.OBJECTIVES), top_n, within=["query_id"])
    poses = staged(overlay.scored(own.join(top.select("query_id", "gid"), ["query_id", "gid"]), queries, **seeding), "poses")
    return poses, staged(overlay.annotated(poses, rows, anchors), "notes")


def equivalence(reference: DataFrame, actual: DataFrame, scores: list[str], tolerance: float = 1e-6) -> DataFrame:
    """By query, two runs over the same rows (query_id, gid, scores): ids that one lacks, greatest error, passed."""
    side = lambda rows, name: rows.select("query_id", "gid", F.struct(*scores).alias(name))
    both = side(reference, "a").join(side(actual, "b"), ["query_id", "gid"], "full")
    gap = F.greatest(F.lit(0.0), *[F.when(F.col(f"a.{s}").isNull() != F.col(f"b.{s}").isNull(), float("inf")).otherwise(F.abs(F.col(f"a.{s}") - F.col(f"b.{s}"))) for s in scores])
    out = both.groupBy("query_id").agg(
        F.count("*").alias("rows"), F.count_if(F.col("a").isNull()).alias("only_second"), F.count_if(F.col("b").isNull()).alias("only_first"),
        F.coalesce(F.max(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), gap)), F.lit(0.0)).alias("max_error"),
    )
    return out.withColumn("passed", (F.col("only_first") + F.col("only_second") == 0) & (F.col("max_error") <= tolerance))
