"""Shards, catalogs, companions, and what searches are asked for."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cairnrank.operators import screening, vectors
from cairnrank.plans.policies import SearchProfile, Selection, strict_json, utc_now
from cairnrank.sources import artifacts as A


def rows(spark, low, high, more=0):
    return spark.createDataFrame([(f"m{k // 3:04d}", k % 3, [[float(k), 0.0, 1.0]] * (k % 4 + more)) for k in range(low, high)], "molecule string, conformer int, features array<array<double>>").repartition(3)


def test_catalog(spark, tmp_path):
    root = str(tmp_path / "lib")
    with pytest.raises(ValueError, match="no shards"):
        A.open_catalog(spark, root, "L")
    first = A.write_shard(rows(spark, 0, 90), root, "a", "L", 0)
    assert A.write_shard(rows(spark, 0, 90), root, "a", "L", 0) == first  # again: nothing to do
    with pytest.raises(ValueError, match="other rows"):
        A.write_shard(rows(spark, 0, 90, 1), root, "a", "L", 0)
    with pytest.raises(ValueError, match="repeat"):
        A.write_shard(rows(spark, 0, 9).union(rows(spark, 0, 1)), root, "x", "L", 0)
    A.write_shard(rows(spark, 90, 150), root, "b", "L", 90)
    c = A.open_catalog(spark, root, "L")
    assert (c.conformers, c.features) == (150, sum(k % 4 for k in range(150))) and len(c.hash) == 64
    every = {r["gid"]: r for r in A.read(spark, c).collect()}
    assert sorted(every) == list(range(150)) and all(every[k]["molecule"] == f"m{k // 3:04d}" and every[k]["conformer"] == k % 3 for k in every)
    light = A.read(spark, c, ["features"], 80, 100)
    assert light.columns == ["gid", "features"] and sorted(r["gid"] for r in light.collect()) == list(range(80, 100)) and "molecule" not in light._jdf.queryExecution().executedPlan().toString()
    one = A.read(spark, c, None, 0, 5).inputFiles()
    assert one and all("/a/" in f for f in one)
    wanted = spark.createDataFrame([(0, 149), (1, 7), (2, 149)], "place int, gid bigint")
    assert sorted((r["place"], r["gid"], r["molecule"]) for r in A.get(spark, c, wanted).collect()) == [(0, 149, "m0049"), (1, 7, "m0002"), (2, 149, "m0049")]
    assert A.get(spark, c, wanted.limit(0)).count() == 0
    for bad in (150, -1, None):
        with pytest.raises(ValueError):
            A.get(spark, c, spark.createDataFrame([(0, bad)], "place int, gid bigint"))
    with pytest.raises(ValueError):
        A.read(spark, c, None, 10, 151)
    with pytest.raises(ValueError, match="another library"):
        A.open_catalog(spark, root, "M")
    A.write_shard(rows(spark, 200, 210), root, "d", "L", 200)
    with pytest.raises(ValueError, match="gap"):
        A.open_catalog(spark, root, "L")


def test_changed_rows_are_found(spark, tmp_path):
    root = str(tmp_path / "lib")
    A.write_shard(rows(spark, 0, 30), root, "a", "L", 0)
    A.read(spark, A.open_catalog(spark, root, "L")).withColumn("conformer", F.col("conformer") + 1).write.parquet(f"{root}/tmp")
    spark.read.parquet(f"{root}/tmp").write.mode("overwrite").parquet(f"{root}/a/rows")
    with pytest.raises(ValueError, match="manifest"):
        A.open_catalog(spark, root, "L")
    assert A.open_catalog(spark, root, "L", verify=False).conformers == 30


def test_companions(spark):
    own = spark.createDataFrame([(0, "a", 0), (1, "a", 1), (2, "b", 0)], "gid bigint, molecule string, conformer int")
    good = own.withColumn("charge", F.col("gid") * 2)
    assert A.identity_faults(own, good).count() == 0
    assert {r["gid"]: r["charge"] for r in A.with_companion(own, good).collect()} == {0: 0, 1: 2, 2: 4}
    bad = good.filter("gid > 0").withColumn("molecule", F.when(F.col("gid") == 2, "c").otherwise(F.col("molecule"))).union(spark.createDataFrame([(9, "z", 0, 1)], good.schema))
    assert {r["gid"]: r["reason"] for r in A.identity_faults(own, bad).collect()} == {0: "missing in the second", 2: "another row", 9: "missing in the first"}
    with pytest.raises(PySparkException):
        A.with_companion(own, bad).collect()


def test_what_is_asked_for():
    assert strict_json('{"a": [1, {"b": null}]}') == {"a": [1, {"b": None}]}
    for text in ('{"a": 1, "a": 2}', '{"a": NaN}', "[Infinity]", "{"):
        with pytest.raises(ValueError):
            strict_json(text)
    assert utc_now().endswith("+00:00") and SearchProfile("loose", 2.0, 1).pairs == 1
    for bad in (("", 1.0, 1), ("a", -1.0, 1), ("a", 1.0, 0), ("a", float("nan"), 1)):
        with pytest.raises(ValueError):
            SearchProfile(*bad)
    rule = screening.CoarseRule((0.5, 2.0), 0.5, 1.0)
    assert Selection(("b", "a"), "all", 0.5, 10, rule).normal() == Selection(("a", "b"), "all", 0.5, None, rule)
    for bad in (((), "all", 0.5), (("a", "a"), "all", 0.5), (("a",), "some", 0.5), (("a",), "any", 0), (("a",), "any", True), (("a",), "any", 0.5, 0), (("a",), "any", 0.5, 1.5)):
        with pytest.raises(ValueError):
            Selection(*bad)


def test_ids_to_look_at(spark):
    import numpy as np

    for total, count in ((1, 1), (5, 9), (100, 7), (1000, 256), (7, 1)):
        want = np.unique(np.linspace(0, total - 1, min(total, count), dtype=np.int64)).tolist()
        assert sorted(r["gid"] for r in vectors.sampled_ids(spark, total, count).collect()) == want
    with pytest.raises(ValueError):
        vectors.sampled_ids(spark, 0, 3)
    scored = spark.createDataFrame([(k, [k / 10, 0.9], [0, -1 if k == 9 else 1]) for k in range(10)], "gid bigint, scores array<double>, assignments array<int>")
    got = {r["gid"]: r["why"] for r in screening.evidence_panel(vectors.sampled_ids(spark, 10, 2), scored, [0, 1], 0.65, most=2).collect()}
    assert got == {0: ["spread"], 9: ["spread"], 7: ["edge", "met"], 8: ["met"], 6: ["edge"]}


def test_molecules_without_a_vector_keep_their_first_score(spark):
    bits = spark.createDataFrame([(k, k, [k, 0]) for k in range(1, 9)], "gid bigint, molecule bigint, vector array<bigint>")
    own = spark.createDataFrame([(k, k, [float(k), 1.0]) for k in range(1, 9) if k % 2], "gid bigint, molecule bigint, vector array<double>")
    rows_ = vectors.hierarchical(bits, own, bits.filter("gid = 1"), own.filter("gid = 1"), 8, 8).collect()
    assert len(rows_) == 8 and all((r["score_3d"] is None) == (r["molecule"] % 2 == 0) for r in rows_)
    assert all(r["combined"] == pytest.approx(r["score_2d"] if r["score_3d"] is None else 0.4 * r["score_2d"] + 0.6 * r["score_3d"]) for r in rows_)
