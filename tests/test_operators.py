"""Operators on small fixtures with known answers."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cairnrank.functions import scalars as S
from cairnrank.operators import fusion, masks, postings, ranking, records, vectors


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_merge_of_ranked_shards(spark):
    shards = spark.createDataFrame([(0, 1, 9, 0.9), (0, 2, 1, 0.8), (0, 3, 7, 0.5), (1, 1, 3, 0.95), (1, 2, 2, 0.8), (1, 3, 8, 0.4), (2, 1, 4, 0.8), (2, 2, 6, 0.7), (2, 3, 9, 0.1)], "shard int, rank int, gid bigint, score double")
    assert [r["gid"] for r in ranking.merged(shards, 6).orderBy("rank").collect()] == [3, 9, 1, 2, 4, 6]
    assert ranking.out_of_order(shards).count() == 0
    assert rows(ranking.out_of_order(spark.createDataFrame([(0, 1, 2, 0.5), (0, 2, 1, 0.7), (0, 3, -4, 0.1), (0, 4, 5, float("nan"))], shards.schema)), "gid") == [(-4,), (1,), (5,)]


def channels(spark):
    data = {"baseline": [(10, 0.9), (20, 0.8), (30, 0.7)], "strict": [(20, 0.99), (40, 0.8), (50, 0.7)], "balanced": [(10, 0.95), (60, 0.7)], "loose": [(70, 0.6), (80, 0.5)]}
    return spark.createDataFrame([(c, g, s, k) for c, x in data.items() for k, (g, s) in enumerate(x, 1)], "channel string, gid bigint, score double, rank bigint")


def test_schedule_within_budgets(spark):
    got = ranking.schedule(channels(spark), {"baseline": 2, "strict": 2, "balanced": 1, "loose": 1}).orderBy("position").collect()
    assert [r["gid"] for r in got] == [10, 20, 40, 50, 60, 70] and [r["source_flags"] for r in got] == [5, 3, 2, 2, 4, 8]
    got = ranking.schedule(channels(spark), {"baseline": 1, "strict": 0, "loose": 5}).orderBy("position").collect()
    assert [r["gid"] for r in got] == [10, 70, 80]
    with pytest.raises(ValueError, match="baseline"):
        ranking.schedule(channels(spark), {"strict": 1})


def test_schedule_against_a_loop(spark):
    import random

    rng = random.Random(3)
    for _ in range(6):
        data = [(c, g, 0.0, k) for c in ranking.CHANNELS for k, g in enumerate(rng.sample(range(30), 12))]
        budgets = {c: rng.randint(0, 8) for c in ranking.CHANNELS}
        want: dict[int, int] = {}
        for bit, c in enumerate(ranking.CHANNELS):
            new = 0
            for _, g, _, _ in (x for x in data if x[0] == c):
                if new >= budgets[c]:
                    break
                new += g not in want
                want[g] = want.get(g, 0) | 1 << bit
        df = spark.createDataFrame(data, "channel string, gid bigint, score double, rank bigint")
        if budgets["baseline"]:
            got = ranking.schedule(df, budgets).orderBy("position").collect()
            assert [(r["gid"], r["source_flags"]) for r in got] == list(want.items())


def test_topk_ties_and_caps(spark):
    corpus = spark.createDataFrame([(9, 0, [1.0]), (1, 0, [1.0]), (3, 0, [0.0]), (0, 0, [1.0]), (4, 0, [float("inf")]), (7, 0, None)], "gid bigint, molecule bigint, vector array<double>")
    asked = spark.createDataFrame([(100, 9, [0.0])], corpus.schema)
    assert [r["gid"] for r in vectors.nearest(corpus, asked, 3).orderBy("rank").collect()] == [3, 0, 1]
    assert vectors.nearest(corpus, asked.limit(0), 3).collect() == []
    capped = ranking.capped(spark.createDataFrame([(8, "A", 1), (2, "A", 2), (4, "B", 3), (5, "C", 4)], "gid bigint, m string, place int"), "m", 2, [F.asc("place")])
    assert [r["gid"] for r in capped.orderBy("rank").collect()] == [8, 4]
    kept = ranking.retained(spark.createDataFrame([(-1, 0.0), (5, 0.3), (2, 0.3), (7, 0.1)], "gid bigint, distance double"), 2)
    assert [r["gid"] for r in kept.orderBy("rank").collect()] == [7, 2]


@pytest.mark.parametrize("block", [1, 4, 2048])
def test_query_blocks_change_nothing(spark, block):
    v = spark.range(60).select(F.col("id").alias("gid"), (F.col("id") % 5).alias("molecule"), F.array(*[(F.hash(F.col("id"), F.lit(k)) % 100 / 10).cast("double") for k in range(4)]).alias("vector"))
    q = v.filter("gid < 6")
    got = rows(vectors.nearest(v, q, 5, standard=True, exclude=True, block=block), "query_id", "gid", "rank")
    assert got == rows(vectors.nearest(v.repartition(7), q, 5, standard=True, exclude=True), "query_id", "gid", "rank") and len(got) == 30
    c = vectors.centroids(v, 4)
    assert rows(vectors.probe(vectors.listed(v, c), q, c, 4, 5), "query_id", "gid", "rank") == rows(vectors.nearest(v, q, 5), "query_id", "gid", "rank")


def test_postings_profiles_and_tiers(spark):
    types = {"HBA": 2, "HBD": 1, "hydrophobe": 5}
    data = [(0, 0, "HBA", 0.0), (0, 1, "HBD", 4.0), (0, 2, "HBA", 8.0), (1, 0, "HBA", 0.0), (1, 1, "HBD", 5.5), (2, 0, "hydrophobe", 0.0)]
    feats = spark.createDataFrame([(g, i, types[t], x, 0.0, 0.0) for g, i, t, x in data], "gid bigint, idx int, type int, x double, y double, z double")
    anchors = spark.createDataFrame([(0, 0, 2, 10.0, 0.0, 0.0), (0, 1, 1, 14.0, 0.0, 0.0), (0, 2, 2, 18.0, 0.0, 0.0)], feats.schema)
    pairs = postings.pairs_of(anchors).select(F.lit("q").alias("query_id"), F.concat_ws("::", "i", "j").alias("pair_id"), "t1", "t2", "distance")
    assert pairs.count() == 3
    found = postings.search(postings.postings(feats), pairs)
    assert dict(rows(found.groupBy("profile").count(), "profile", "count")) == {"loose": 2, "balanced": 1, "strict": 1}
    tiers = postings.tiers(found, spark.createDataFrame([("q", 2)], "query_id string, gid bigint"))
    assert rows(tiers, "gid", "tier", "source_flags") == [(0, 3, 1), (1, 1, 1), (2, 0, 2)]
    assert postings.not_nested(found).isEmpty()
    assert postings.pairs_of(anchors.limit(1)).isEmpty()


def test_postings_are_probed_as_they_are_joined(spark):
    rng = np.random.default_rng(3)
    feats = spark.createDataFrame([(g, i, int(rng.integers(1, 4)), *map(float, rng.normal(size=3) * 6)) for g in range(60) for i in range(rng.integers(1, 8))], "gid bigint, idx int, type int, x double, y double, z double")
    pairs = postings.pairs_of(feats.filter("gid % 20 = 0 or gid < 5")).select(F.col("gid").alias("query_id"), F.concat_ws("::", F.col("i") % 3, F.col("j") % 3).alias("pair_id"), "t1", "t2", "distance")
    cols = ("query_id", "gid", "profile", "matched")
    for width, most in ((0.5, 20.0), (0.1, 20.0), (0.5, 4.0)):  # 0.1: bins of several words
        for asked in (pairs, pairs.withColumn("query_id", F.concat(F.lit("q"), "query_id")), pairs.filter("false")):
            index = postings.postings(feats, width)
            got = postings.search(index, asked, width=width, most=most)
            assert rows(got, *cols) == rows(postings._joined(index, asked, postings.PROFILES, width, most), *cols) and got.isEmpty() == asked.isEmpty()
    assert "MapInArrow" in got._jdf.queryExecution().toString()


RESULTS = [("Q1", "R1", 1, "M1", 0.80), ("Q1", "R1", 2, "M1", 0.90), ("Q1", "R1", 3, "M2", 0.85), ("Q2", "R2", 4, "M2", 0.95), ("Q2", "R2", 5, "M3", 0.80)]


def fused(spark, scale=1.0, site2="SITE-A", limit=4):
    data = [("SITE-A" if q == "Q1" else site2, q, r, m, g, s * (scale if q == "Q1" else 1)) for q, r, g, m, s in RESULTS]
    e = fusion.evidence(spark.createDataFrame(data, "site_id string, query_id string, receptor_id string, molecule_id string, gid bigint, score double"))
    s = fusion.site_summary(e)
    return e, s, fusion.admission(e, s, 1, 3, limit)


def test_fusion(spark):
    e, s, a = fused(spark)
    assert rows(e.filter("query_id = 'Q1' and molecule_id = 'M1'"), "gid", "query_molecule_rank", "query_rank_percentile") == [(2, 1, 1.0)]
    assert rows(s, "molecule_id", "query_support", "site_consensus_rank") == [("M1", 1, 2), ("M2", 2, 1), ("M3", 1, 3)]
    assert rows(a, "site_admission_rank", "molecule_id") == [(1, "M1"), (2, "M2"), (3, "M3")]
    t = fusion.tasks(e, a)
    assert rows(t, "molecule_id", "receptor_id") == [("M1", "R1"), ("M2", "R1"), ("M2", "R2"), ("M3", "R2")] and t.select("docking_task_id").distinct().count() == 4
    assert rows(fused(spark, 100.0)[2], "site_admission_rank", "molecule_id") == rows(a, "site_admission_rank", "molecule_id")
    assert fused(spark, site2="SITE-B")[1].filter("site_consensus_rank = 1").count() == 2
    assert rows(fusion.quota_faults(e, 2, 3), "site_id") == [("SITE-A",)] and fusion.quota_faults(e, 2, 4).isEmpty()


def test_consensus_stops_at_a_full_site(spark):
    _, _, a = fused(spark, limit=2)
    got = {r["molecule_id"]: r["admission_reasons"] for r in a.collect()}
    assert got == {"M1": ["protected_query:Q1", "site_consensus"], "M2": ["protected_query:Q2", "site_consensus"]}


def test_selection_holds_within_one_pose(spark):
    data = [(1, "m1", 0.9, [0.8, 0.1]), (2, "m1", 0.8, [0.1, 0.8]), (3, "m2", 0.7, [0.7, 0.7]), (4, "m3", 0.7, [0.7, 0.7])]
    p = spark.createDataFrame([(g, m, s, a, [0, 1]) for g, m, s, a in data], "gid bigint, molecule string, score double, scores array<double>, assignments array<int>")
    pick = lambda policy: rows(masks.selection(p, masks.pose_passes("scores", "assignments", [0, 1], 0.5, policy), 9), "rank", "molecule")
    assert pick("all") == [(1, "m2"), (2, "m3")] and pick("any") == [(1, "m1"), (2, "m2"), (3, "m3")]
    for bad in (0, -1, float("nan"), 1.1, True):
        with pytest.raises(ValueError, match="score"):
            masks.pose_passes("scores", "assignments", [0], bad, "all")


def test_mask_counts_join_poses(spark):
    scores = [("m0", 0.9, 0.1), ("m0", 0.1, 0.9), ("m1", 0.1, 0.1), ("m2", 0.8, 0.8)]
    p = spark.createDataFrame(scores, "molecule string, a double, b double").withColumn("mask", S.mask_of([F.col("a") >= 0.5, F.col("b") >= 0.5]))
    assert rows(masks.bit_counts(p, "molecule", "mask", 2), "bit", "molecules", "poses") == [(0, 2, 2), (1, 2, 2)]
    assert rows(masks.mask_histogram(p, "molecule", "mask"), "mask", "molecules") == [(0, 1), (1, 1), (2, 1), (3, 1)]


def test_average_ranks_and_agreement(spark):
    r = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.9)], "k int, v double").withColumn("g", F.lit(0))
    assert rows(ranking.average_ranks(r, "v", ["g"]), "k", "average_rank") == [(1, 0.0), (2, 1.5), (3, 1.5)]
    flat = ranking.spearman(r.withColumn("w", F.lit(1.0)), "v", "w", ["g"]).first()
    assert flat["spearman"] is None


def test_scalars(spark):
    df = spark.createDataFrame([("  Ab c--D! ", "a/b:c"), ("***", "._.")], "a string, b string")
    assert rows(df.select(S.slugify(F.col("a")).alias("s"), S.safe_name(F.col("b")).alias("n")).na.fill("-"), "s", "n") == [("-", "item"), ("ab-c-d", "a_b_c")]
    names = spark.createDataFrame([("macro_A_conf0",), ("macro_A_conf_12",), ("macro_confidence",)], "n string")
    m, c = S.split_conformer(F.col("n"))
    assert rows(names.select(m.alias("m"), c.alias("c")), "m", "c") == [("macro_A", 0), ("macro_A", 12), ("macro_confidence", 0)]
    key = spark.range(1).select(S.pair_key(F.lit(5), F.lit(2), F.lit(9)).alias("k")).select("k", *[x.alias(f"p{i}") for i, x in enumerate(S.pair_of(F.col("k")))]).first()
    assert tuple(key)[1:] == (2, 5, 9)
    q = spark.createDataFrame([(0.025,), (0.015,)], "x double").select(S.quantised(F.col("x"), F.lit(0.0)).alias("q"))
    assert rows(q, "q") == [(2,), (2,)]
    with pytest.raises(PySparkException):
        spark.createDataFrame([(400.0,)], "x double").select(S.quantised(F.col("x"), F.lit(0.0))).collect()
    assert rows(spark.createDataFrame([("H-B_A",), ("x",)], "n string").select(F.coalesce(S.feature_type(F.col("n")), F.lit(0)).alias("t")), "t") == [(0,), (2,)]


def test_records(spark):
    known = spark.createDataFrame([("m", 0, "x")], "m string, i int, d string")
    new = spark.createDataFrame([("m", 0, "x", 1), ("m", 0, "y", 2), ("m", 1, "z", 3), ("m", 1, "z", 4), ("m", 1, "w", 5)], "m string, i int, d string, o int")
    assert rows(records.imported(new, known, ["m", "i"], "d", ["o"]), "o", "outcome") == [(1, "duplicate"), (2, "conflict"), (3, "inserted"), (4, "duplicate"), (5, "conflict")]
    assert rows(records.preserved_index(new, "m", "i", ["o"]), "o", "internal_index") == [(1, 0), (2, -1), (3, 1), (4, -2), (5, -3)]
    shards = spark.createDataFrame([(0, 5), (5, 3), (9, 1)], "start bigint, count bigint")
    assert rows(records.catalog_faults(shards), "start", "expected") == [(9, 8)]
    assert records.same_rows(shards, shards.repartition(2)) and not records.same_rows(shards, shards.limit(2))
    s = spark.createDataFrame([("a", 90), ("b", 9), ("c", 1)], "shard string, size bigint")
    got = dict(rows(records.stratified_counts(s, 10), "shard", "take"))
    assert sum(got.values()) == 10 and min(got.values()) >= 1 and got["a"] == 7


def test_settings_and_equivalence(spark):
    runs = spark.createDataFrame([(1, 0.9), (1, 1.0), (2, 0.5)], "n int, r double")
    assert rows(records.settings_summary(runs, ["n"], "r", 0.8), "n", "runs", "passes") == [(1, 2, True), (2, 1, False)]
    a, b = (spark.createDataFrame(x, "id bigint, s double") for x in ([(1, 1.0), (2, 2.0)], [(1, 1.25), (3, 1.0)]))
    assert tuple(records.score_equivalence(a, b, ["id"], "s").first()) == (0.25, 1, 1, 3)


def test_global_ranks(spark):
    df = spark.range(0, 500, 1, 9).select("id", (F.hash("id") % 50).alias("v"))
    by = [F.desc("v"), F.asc("id")]
    assert rows(ranking.ranked_globally(df, by), "id", "rank") == rows(ranking.ranked(df, by), "id", "rank")
    assert ranking.ranked_globally(df.limit(0), by).collect() == []
