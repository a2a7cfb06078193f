"""Fusion of independent queries: evidence, reciprocal rank fusion, admission by quota, tasks, and overlap reports.

Scores of different queries are never mixed; only ranks are. Sites are independent of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnrank.functions.scalars import task_id
from cairnrank.operators.ranking import collapse, correlation, ranked, ranked_by_range


def evidence(results: DataFrame) -> DataFrame:
    """Rows (site_id, query_id, receptor_id, molecule_id, gid, score) to one a query and molecule, with its rank.

    The molecule's best row by (score desc, gid asc); rank by (score desc, molecule_id); percentile 1 - (rank-1)/max(1,n-1).
    """
    best = collapse(results, ["site_id", "query_id", "receptor_id", "molecule_id"])
    out = ranked_by_range(best, "query_id", [F.desc("score"), F.asc("molecule_id")], "query_molecule_rank", "_n")
    return out.withColumn("query_rank_percentile", 1 - (F.col("query_molecule_rank") - 1) / F.greatest(F.lit(1), F.col("_n") - 1)).drop("_n")


def site_summary(rows: DataFrame, rrf_k: int = 60) -> DataFrame:
    """Molecules by site: supports, best rank and percentile, reciprocal rank fusion, consensus rank."""
    out = rows.groupBy("site_id", "molecule_id").agg(
        F.countDistinct("query_id").alias("query_support"), F.countDistinct("receptor_id").alias("receptor_support"),
        F.min("query_molecule_rank").alias("best_query_rank"), F.max("query_rank_percentile").alias("best_percentile"),
        F.round(F.sum(1.0 / (rrf_k + F.col("query_molecule_rank"))), 12).alias("rrf_score"),
    )
    return ranked_by_range(out, "site_id", [F.desc("rrf_score"), F.asc("best_query_rank"), F.asc("molecule_id")], "site_consensus_rank")


def admission(rows: DataFrame, summary: DataFrame, quota: int, consensus: int, limit: int) -> DataFrame:
    """Molecules admitted by site: each query's first ``quota``, then consensus ranks while the site has room.

    Consensus molecules are read in rank order, ``consensus`` at most, until one would be new to a full site; that one and
    all later ones get no consensus reason. Result: site_id, molecule_id, site_admission_rank, admission_reasons.
    ``limit`` must hold all quotas of a site (see ``quota_faults``).
    """
    queries = rows.groupBy("site_id", "molecule_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("query_molecule_rank") <= quota, F.concat(F.lit("protected_query:"), F.col("query_id"))))).alias("reasons"),
        F.min(F.when(F.col("query_molecule_rank") <= quota, F.struct("query_id", "query_molecule_rank"))).alias("place"),
    )
    protected = queries.filter("place is not null")
    room = protected.groupBy("site_id").agg(F.count("*").alias("held"))
    shortlist = summary.filter(F.col("site_consensus_rank") <= consensus).select("site_id", "molecule_id", "site_consensus_rank")
    listed = shortlist.join(protected.select("site_id", "molecule_id", F.lit(1).alias("old")), ["site_id", "molecule_id"], "left").join(room, "site_id", "left")
    fresh = F.sum(F.when(F.col("old").isNull(), 1).otherwise(0)).over(Window.partitionBy("site_id").orderBy("site_consensus_rank"))
    listed = listed.withColumn("fresh", fresh).filter(F.coalesce("held", F.lit(0)) + F.col("fresh") <= limit)
    listed = listed.select("site_id", "molecule_id", F.col("site_consensus_rank").alias("consensus"))
    both = protected.join(listed, ["site_id", "molecule_id"], "full")
    reasons = F.concat(F.coalesce("reasons", F.array().cast("array<string>")), F.when(F.col("consensus").isNotNull(), F.array(F.lit("site_consensus"))).otherwise(F.array().cast("array<string>")))
    order = [F.asc_nulls_last("place"), F.asc("consensus")]
    out = ranked(both.withColumn("admission_reasons", reasons), order, ["site_id"], "site_admission_rank")
    return out.select("site_id", "molecule_id", "site_admission_rank", "admission_reasons")


def quota_faults(rows: DataFrame, quota: int, limit: int) -> DataFrame:
    """Sites whose limit can't hold all their queries' quotas."""
    return rows.groupBy("site_id").agg(F.countDistinct("query_id").alias("queries")).filter(F.col("queries") * quota > limit)


def tasks(rows: DataFrame, admitted: DataFrame) -> DataFrame:
    """A task for each admitted molecule and each query that found it, with a stable id."""
    out = rows.join(admitted, ["site_id", "molecule_id"])
    key = [F.col(c).cast("string") for c in ("site_id", "molecule_id", "query_id", "receptor_id")]
    return out.select(
        task_id(*key).alias("docking_task_id"), "site_id", "molecule_id", "query_id", "receptor_id", "gid", F.col("score").alias("search_score"),
        "query_molecule_rank", "site_admission_rank", F.array_join("admission_reasons", ",").alias("reasons"),
    )


def reason_counts(admitted: DataFrame) -> DataFrame:
    return admitted.select("site_id", F.explode("admission_reasons").alias("reason")).groupBy("site_id", "reason").agg(F.count("*").alias("molecules"))


def set_report(rows: DataFrame) -> DataFrame:
    """By site: molecules found by any query, by all, by one alone."""
    queries = rows.groupBy("site_id").agg(F.countDistinct("query_id").alias("queries"))
    each = rows.groupBy("site_id", "molecule_id").agg(F.countDistinct("query_id").alias("n"))
    return each.join(queries, "site_id").groupBy("site_id", "queries").agg(
        F.count("*").alias("found"), F.count_if(F.col("n") == F.col("queries")).alias("shared_all"), F.count_if(F.col("n") == 1).alias("exclusive")
    )


def top_overlap(rows: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Pairs of a site's queries: shared molecules of their tops, Jaccard and overlap coefficient, for each k.

    Rows meet by molecule, cut to the largest k first, so a query sends that many rows at most.
    """
    tops = rows.filter(F.col("query_molecule_rank") <= max(ks)).select("site_id", "query_id", "molecule_id", F.col("query_molecule_rank").alias("r"))
    sizes = tops.select("site_id", "query_id", F.explode(F.array(*map(F.lit, ks))).alias("k"), "r").filter("r <= k").groupBy("site_id", "query_id", "k").agg(F.count("*").alias("n"))
    a = tops.select("site_id", "molecule_id", F.col("query_id").alias("a"), F.col("r").alias("ra"))
    b = tops.select("site_id", "molecule_id", F.col("query_id").alias("b"), F.col("r").alias("rb"))
    both = a.join(b, ["site_id", "molecule_id"]).filter("a < b")
    both = both.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).filter("ra <= k and rb <= k").groupBy("site_id", "a", "b", "k").agg(F.count("*").alias("shared"))
    pairs = sizes.select("site_id", "k", F.col("query_id").alias("a"), F.col("n").alias("na")).join(sizes.select("site_id", "k", F.col("query_id").alias("b"), F.col("n").alias("nb")), ["site_id", "k"]).filter("a < b")
    out = pairs.join(both, ["site_id", "a", "b", "k"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)).cast("bigint"))
    return out.select(
        "site_id", "a", "b", F.col("k").cast("bigint").alias("k"), "shared",
        (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"), (F.col("shared") / F.least("na", "nb")).alias("overlap"),
    )


def shared_rank_correlation(rows: DataFrame) -> DataFrame:
    """Pairs of a site's queries: correlation of the ranks they gave the molecules both found; null below two.

    A molecule's queries meet in one array, so rows shuffle once; pairs of a molecule are summed before they shuffle again.
    """
    each = rows.groupBy("site_id", "molecule_id").agg(F.sort_array(F.collect_list(F.struct("query_id", "query_molecule_rank"))).alias("q"))
    first = each.filter(F.size("q") > 1).select("site_id", "q", F.posexplode("q").alias("at", "one"))
    both = first.select("site_id", "one", F.explode(F.slice("q", F.col("at") + 2, F.size("q"))).alias("two"))
    both = both.select("site_id", F.col("one.query_id").alias("a"), F.col("two.query_id").alias("b"), F.col("one.query_molecule_rank").alias("ra"), F.col("two.query_molecule_rank").alias("rb"))
    return both.groupBy("site_id", "a", "b").agg(F.count("*").alias("shared"), correlation("ra", "rb", 1e-12).alias("rank_correlation"))
