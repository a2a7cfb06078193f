"""Reviews, hypotheses, validation, packages and registry rules against brute force and known answers."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairnrank.functions import geometry as G
from cairnrank.operators import overlay, registry, review, screening, vectors
from cairnrank.plans import calibrated, validation
from cairnrank.plans.queries import QUERIES
from cairnrank.sources import packages

_CLOUD = "gid bigint, idx bigint, type bigint, x double, y double, z double"


@pytest.fixture(scope="module")
def clouds():
    rng = np.random.default_rng(12)
    out = {}
    for g in range(14):
        n = 6 if g == 0 else int(rng.integers(4, 8))
        out[g] = (rng.normal(0, 1.2, (n, 3)), rng.integers(1, 4, n))
    q, t = out[0]
    turn = G.homogeneous(G.about(np.array([0, 0, 1.0]), np.array([0.8])), np.ones((1, 3)))
    out[14] = (G.moved(q, turn)[0] + rng.normal(0, 0.05, q.shape), t)  # nearly the query, elsewhere
    return out


@pytest.fixture(scope="module")
def asked(spark, clouds):
    rows = [(g, k, int(t[k]), *map(float, p[k])) for g, (p, t) in clouds.items() for k in range(len(t))]
    f = spark.createDataFrame(rows, _CLOUD)
    q, qt = clouds[0]
    coarse = screening.summaries(f, f)
    how = screening.Conditions(
        {0: G.Overlay(q, q, qt, [1.0] * 6, (0, 1, 2))}, screening.CoarseQueries(coarse.filter("gid = 0").collect(), screening.CoarseRule((0.5, 1.5), 0.3, 0.9)),
        {0: overlay.anchors_of(q[:3], qt[:3], [1.5, 1.0, 1.0])}, 0.4,
    )
    return overlay.nested(f), coarse, how


def test_evidence_counts_take_numbers_alone(spark):
    nan = float("nan")
    rows = [(1, 7, [0.5, nan], [0, 1]), (1, 7, [0.8, 0.3], [2, -1]), (1, 8, [0.25, None], [0, 0]), (2, 7, [0.9], [0])]
    poses = spark.createDataFrame(rows, "query_id int, molecule int, scores array<double>, assignments array<int>")
    anchors = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "c", 0), (3, "d", 0)], "query_id int, anchor_id string, score_column int")
    got = {(r["anchor_id"], r["level"]): (r["conformers"], r["molecules"]) for r in review.evidence_counts(poses, anchors).collect()}
    want = {0.25: (3, 2), 0.5: (2, 1), 0.75: (1, 1)}
    assert all(got["a", t] == got["c", t] == want[t] and got["b", t] == got["d", t] == (0, 0) for t in review.LEVELS)


def test_anchor_faults_and_columns(spark):
    a = spark.createDataFrame([("q", "a", 1.0), ("q", "b", None), ("q", "c", 2.0)], "query_id string, anchor_id string, angle double")
    m = spark.createDataFrame([("q", "a", 9), ("q", "b", 4), ("q", "x", 4)], "query_id string, anchor_id string, feature_index int")
    assert {tuple(r) for r in review.anchor_faults(a, m).collect()} == {("q", "c", "no feature"), ("q", "x", "no anchor")}
    assert {(r["anchor_id"], r["score_column"], r["evidence_class"]) for r in review.anchor_columns(a, m).collect()} == {("a", 1, "with_reported_angle"), ("b", 0, "without_reported_angle")}


def test_hypotheses_against_brute_force(spark):
    rng = np.random.default_rng(5)
    atoms, number = [], 0
    for residue in ["PHE", "LYS", "ASP", "TRP", "ARG", "LEU", "HIS", "GLU"] * 3:
        number += 1
        middle = rng.uniform(-7, 7, 3)
        names = {n for g in review.RINGS.get(residue, ()) for n in g.split()} | set(review.HYDROPHOBIC.get(residue, "").split()) | set(review.CHARGED.get(residue, (0, ""))[1].split())
        flat = G.about(rng.normal(size=3), np.array([rng.uniform(0, 3)]))[0]
        around = "CG CD1 NE1 CE2 CZ2 CH2 CZ3 CE3 CD2" if residue == "TRP" else " ".join(review.RINGS.get(residue, ()))
        order = around.split() + sorted(names - set(around.split()))  # rings whose sides don't cross
        for k, n in enumerate(order):
            turn = 2 * np.pi * k / len(order)
            own = np.array([np.cos(turn), np.sin(turn), 0]) * 1.4 @ flat.T + middle
            if not (residue == "ARG" and number % 2 and n == "NH2"):  # some groups are not whole
                atoms.append(("A", number, residue, n, n[0], *map(float, own)))
    atoms += [("B", 900 + k, s, s, s, *map(float, rng.uniform(-5, 5, 3))) for k, s in enumerate(["ZN", "MG", "Na"])]
    df = spark.createDataFrame(atoms, "chain string, number int, residue string, atom string, symbol string, x double, y double, z double")
    found = review.partners(df)
    # partners by hand
    by = {}
    for c, n, r, a, s, *p in atoms:
        by.setdefault((c, n, r), {})[a] = np.array(p)
    want = []
    for (c, n, r), own in by.items():
        want += [("hydrophobic", c, n, r, a, own[a], None) for a in review.HYDROPHOBIC.get(r, "").split() if a in own]
        want += [("metal", c, n, r, r, own[r], None)] if r in review.METALS else []
        for names in review.RINGS.get(r, ()):
            if all(a in own for a in names.split()):
                p = np.array([own[a] for a in names.split()])
                want.append(("ring", c, n, r, names.replace(" ", "/"), p.mean(axis=0), np.linalg.svd(p - p.mean(axis=0))[2][2]))
        if r in review.CHARGED and all(a in own for a in review.CHARGED[r][1].split()):
            sign, names = review.CHARGED[r]
            want.append(("positive" if sign > 0 else "negative", c, n, r, names.replace(" ", "/"), np.mean([own[a] for a in names.split()], axis=0), None))
    got = {(r["class"], r["number"], r["atom"]): r for r in found.collect()}
    assert set(got) == {(k, n, a) for k, _, n, _, a, *_ in want}
    for k, _, n, _, a, p, normal in want:
        r = got[k, n, a]
        assert np.allclose([r["x"], r["y"], r["z"]], p) and (normal is None) == (r["nx"] is None)
        if normal is not None:
            assert abs(np.dot([r["nx"], r["ny"], r["nz"]], normal)) == pytest.approx(1)
    features = []
    for k in range(60):
        d = rng.normal(size=3)
        features.append((0, k, int(rng.integers(1, 7)), 2 if k % 5 else 0, *map(float, rng.uniform(-7, 7, 3)), *map(float, d / np.linalg.norm(d))))
    f = spark.createDataFrame(features, "query_id int, feature_index int, type int, kind int, x double, y double, z double, dx double, dy double, dz double")
    best = {}
    for _, k, kind, axis, *v in features:
        p, d = np.array(v[:3]), np.array(v[3:])
        for name, t, cls, most in review.RULES:
            for cl, c, n, r, a, q, normal in want:
                far = np.linalg.norm(p - q)
                if t != kind or cl != cls or far > most:
                    continue
                if name == "pi_stacking":
                    angle, delta = np.degrees(np.arccos(min(1, abs(d @ normal)))), p - q
                    off = min(np.linalg.norm(delta - (delta @ x) * x) for x in (d, normal))
                    if axis != 2 or 30 < angle < 60 or off > 2:
                        continue
                key = (k, name, n, "" if name == "hydrophobic" else a)
                if key not in best or far < best[key][0]:
                    best[key] = (far, a)
    rows = {(r["feature_index"], r["interaction"], r["number"], "" if r["interaction"] == "hydrophobic" else r["atom"]): (r["distance"], r["atom"]) for r in review.hypotheses(f, found).collect()}
    assert set(rows) == set(best) and len(best) > 10 and all(rows[k][1] == best[k][1] and rows[k][0] == pytest.approx(best[k][0]) for k in best)
    both = review.classified_anchors(spark.createDataFrame([(0, "h", 3)], "query_id int, anchor_id string, feature_index int"), review.hypotheses(f, found)).collect()
    place = {v: n for n, v in enumerate(sorted({r["feature_index"] for r in both}))}
    assert all(r["score_column"] == place[r["feature_index"]] for r in both) and len(both) == len(best) + 1


def test_scale_validation_finds_what_differs(spark, asked, clouds):
    rows, _, how = asked
    stressed = validation.stressed(rows, how.anchors)
    good = validation.scale_validation(stressed).collect()
    assert [r["comparisons"] for r in good] == [len(clouds)] * 3 and all(r["passed"] for r in good)
    bad = stressed.withColumn("batched", F.when((F.col("gid") == 3) & (F.col("orientation") == 1), F.col("batched") + 5).otherwise(F.col("batched")))
    assert sorted((r["orientation"], r["passed"], r["moved"] > 0) for r in validation.scale_validation(bad).collect()) == [(0, True, False), (1, False, True), (2, True, False)]


def test_scales_validated_without_a_row_a_comparison(spark, asked, clouds, monkeypatch):
    """Cells found whole in a task, from several broadcast blocks, are those of the rows; too many candidates go by rows."""
    rows, _, how = asked
    blocks = [how.anchors, {1: overlay.anchors_of(clouds[1][0][:2], clouds[1][1][:2], [1.0, 2.0])}]
    rows = rows.withColumn("molecule", F.col("gid") % 4)
    want = sorted(validation.scale_validation(validation.stressed(rows, {k: a for b in blocks for k, a in b.items()})).drop("max_error").collect())
    monkeypatch.setattr(validation, "PART", 6)
    assert sorted(validation.scales_validated(rows, blocks).drop("max_error").collect()) == want and len(want) == 6
    monkeypatch.setattr(validation, "stressed", None)  # no row was made, and none can be
    assert sorted(validation.scales_validated(rows, blocks).drop("max_error").collect()) == want
    monkeypatch.undo()
    monkeypatch.setattr(validation, "WHOLE", 3)
    assert sorted(validation.scales_validated(rows, blocks).drop("max_error").collect()) == want


def test_compared_finds_what_differs(clouds, monkeypatch):
    """A batched score that is off, in places and assignments, shows as such; the reference shares no step with it."""
    table = pa.table({"gid": list(clouds), "molecule": [g % 4 for g in clouds], "features": [p.tolist() for p, _ in clouds.values()], "types": [t.tolist() for _, t in clouds.values()]})
    held, anchors = validation._Rows(table), overlay.anchors_of(clouds[0][0][:3], clouds[0][1][:3], [1.5, 1.0, 1.0])
    n, error, *others = validation._compared(held, anchors, 1)
    assert n == len(clouds) and error < 1e-12 and others == [0, 0, 0]
    plain = G.interactions

    def worse(*args):
        total, own, scores = plain(*args)
        return 1 - total, np.where(own == 0, 1, own), scores

    monkeypatch.setattr(G, "interactions", worse)
    n, error, other, moved, molecules = validation._compared(held, anchors, 1)
    assert n == len(clouds) and error > 0.1 and other > 0 and moved > n // 2 and molecules == 4


def test_interactions_of_rows_of_the_same_types():
    """Both kernels against one pose after the other: anchors of distinct and of shared types, and one without a feature."""
    rng = np.random.default_rng(6)
    types, points = rng.integers(1, 5, 9), rng.normal(0, 1.5, (40, 9, 3))
    turn, shift = G.about(rng.normal(size=3), np.array([0.9]))[0], rng.normal(0, 0.5, (40, 3))
    m = G.homogeneous(np.tile(turn, (40, 1, 1)), shift)
    for kinds in ([1, 2, 3], [1, 1, 2], [2, 9, 2, 4]):
        anchors = overlay.anchors_of(rng.normal(0, 1, (len(kinds), 3)), kinds, rng.random(len(kinds)) + 0.5)
        zero, none = np.zeros_like(points), np.zeros(points.shape[:2], int)
        want = [G.interaction(*anchors[:4], anchors[4], G.moved(p, m[k : k + 1])[0], types, zero[k], none[k]) for k, p in enumerate(points)]
        many = G.interactions(anchors, points, np.tile(types, (40, 1)), zero, none, m)
        for total, own, scores in (many, G.interaction_rows(anchors, points.transpose(2, 1, 0), types, turn, shift.T)):
            assert np.allclose(total, [w[0] for w in want], atol=1e-12) and (own == [w[1] for w in want]).all() and np.allclose(scores, [w[2] for w in want], atol=1e-12)


def test_suite(spark, asked, clouds):
    rows, coarse, how = asked
    (own,) = validation.self_controls(rows, coarse, how).collect()
    assert all(own[c] for c in ("joint", "bound", "seed", "identity", "selected"))
    panel = validation.survivor_panel(spark.createDataFrame([(0,), (14,)], "gid bigint"), spark.range(1, 14).toDF("gid"), 5)
    assert sorted(r["gid"] for r in panel.collect()) == [0, 1, 4, 7, 10, 13, 14]
    (r,) = validation.survivors(rows, coarse, how, panel).collect()
    assert (r["rows"], r["false_rejections"], r["false_matches"]) == (7, 0, 0) and r["matches"] >= 2 and r["max_error"] <= 1e-6
    whole = validation.suite(rows, coarse, how, panel)
    assert whole.count() == len(clouds) and {0, 14} <= {r["gid"] for r in whole.filter("passed").collect()}
    off = screening.Conditions(how.overlays, how.coarse, {0: overlay.anchors_of(how.anchors[0][0] + 50, how.anchors[0][1], [1, 1, 1])}, 0.4)
    with pytest.raises(ValueError, match="own queries fail"):
        validation.suite(rows, coarse, off, panel)


def test_allocation_never_exceeds_a_shard(spark):
    shards = spark.createDataFrame([("a", 1), ("b", 9), ("c", 2)], "shard string, size bigint")
    for n in range(3, 13):
        take = {r["shard"]: r["take"] for r in validation.allocated(shards, n).collect()}
        assert sum(take.values()) == n and 1 <= take["b"] <= 9 and take["a"] == 1 and 1 <= take["c"] <= 2
    for n in (2, 13):
        with pytest.raises(ValueError):
            validation.allocated(shards, n)


def test_acceptance_is_bound():
    done = {"status": "passed", "catalog": "x", "rows": 3}
    assert validation.bound(done, {"catalog": "x", "rows": 4}, ("catalog", "rows", "index")) == ["rows", "index"]
    with pytest.raises(ValueError):
        validation.bound({"status": "running"}, done, ("rows",))


def test_calibrated_stages(spark, asked):
    rows, _, how = asked
    found = spark.createDataFrame([(0, g) for g in (0, 3, 5, 14)], "query_id bigint, gid bigint")
    poses, notes = calibrated.pose_stages(rows, found, how.overlays, how.anchors, 3)
    full = overlay.scored(rows.filter("gid in (0, 3, 5, 14)"), how.overlays)
    same = calibrated.equivalence(full.join(poses.select("query_id", "gid"), ["query_id", "gid"]), poses, list(G.OBJECTIVES)).first()
    assert same["passed"] and same["rows"] == notes.count() >= 3
    other = calibrated.equivalence(full, poses.filter("gid <> 14"), list(G.OBJECTIVES)).first()
    assert not other["passed"] and other["only_first"] >= 1
    x = spark.createDataFrame([(k, k, [float(k % 9), float(k % 4), float(k)]) for k in range(200)], "gid bigint, molecule bigint, vector array<double>")
    c = vectors.centroids(x, 4)
    truth, q = vectors.nearest(x, x.filter("gid % 20 = 0"), 5), x.filter("gid % 20 = 0")
    runs = calibrated.sweep(vectors.listed(x, c), q, c, (1, 4), 5, truth)
    least = calibrated.chosen(runs, 10, 1.0)
    assert least in (1, 4) and calibrated.chosen(runs, 11, 1.0) is None
    exact = calibrated.candidates(vectors.listed(x, c), x, q, c, None, 5)
    assert sorted(map(tuple, exact.select("query_id", "gid").collect())) == sorted(map(tuple, truth.select("query_id", "gid").collect()))


def test_calibrated_query_keeps_to_candidates(spark):
    rows = QUERIES["calibrated_search"](spark, "/root/testdata/sf0.001").collect()
    assert {(r["query_id"], r["gid"]) for r in rows} >= {(g, g) for g in {r["query_id"] for r in rows}}  # a cloud is its own best


def test_query_packages(spark, tmp_path):
    schema = "query_id string, shape array<array<double>>, features array<array<double>>, types array<int>, directions array<array<double>>, kinds array<int>, weights array<double>, anchors array<int>"
    good = ("q", [[0.0, 0.0, 0.0]], [[1.0, 0.0, 0.0], [0.0, 2.0, 0.0]], [1, 2], [[0.0, 0.0, 1.0], [0.0, 0.0, 0.0]], [2, 0], [1.0, 0.0], [1, 0, 1])
    bad = {
        "shape": (1, []), "features": (2, [[1.0, float("nan"), 0.0], [0.0, 0.0, 0.0]]), "lengths": (3, [1]), "weights": (6, [1.0, -1.0]), "directions": (4, [[0.0, 0.0, 1.0]]), "kinds": (5, [3, 0]),
        "unit directions": (4, [[0.0, 0.0, 2.0], [0.0, 0.0, 0.0]]), "anchors": (7, [2]),
    }
    rows = [good] + [tuple(v if k == at else (n if k == 0 else x) for k, x in enumerate(good)) for n, (at, v) in bad.items()]
    df = spark.createDataFrame(rows, schema)
    assert {r["query_id"]: r["reason"] for r in packages.query_faults(df).collect()} == {n: n for n in bad}
    with pytest.raises(ValueError, match="faults"):
        packages.write_queries(df, str(tmp_path / "x"))
    folder = str(tmp_path / "q")
    packages.write_queries(df.filter("query_id = 'q'").drop("directions", "kinds"), folder)
    (r,) = packages.load_queries(spark, folder).collect()
    assert r["anchors"] == [0, 1] and r["kinds"] == [0, 0] and r["directions"] == [[0.0] * 3] * 2
    df.filter("query_id = 'q'").write.mode("overwrite").parquet(f"{folder}/rows")
    with pytest.raises(ValueError, match="receipt"):
        packages.load_queries(spark, folder)


def test_chunks(spark, tmp_path):
    df = spark.range(10, 15).select(F.col("id").alias("gid"), (F.col("id") % 8).cast("int").alias("stage_level"))
    packages.write_chunk(df, str(tmp_path), "fine", 2, 0, 5, {"k": 1})
    assert packages.verify_chunk(spark, str(tmp_path), "fine", 2, 0, 5, {"k": 1}, 7).count() == 5
    for args, stages in (((2, 0, 5, {"k": 2}), None), ((2, 1, 6, {"k": 1}), None), ((2, 0, 5, {"k": 1}), 5)):
        with pytest.raises(ValueError):
            packages.verify_chunk(spark, str(tmp_path), "fine", *args, stages=stages)
    with pytest.raises(ValueError):
        packages.write_chunk(df, str(tmp_path), "fine", 3, 0, 4, {})
    df.withColumn("gid", F.col("gid") + 1).write.mode("overwrite").parquet(f"{tmp_path}/stage=fine/chunk=2/rows")
    with pytest.raises(ValueError, match="receipt"):
        packages.verify_chunk(spark, str(tmp_path), "fine", 2, 0, 5, {"k": 1})


def test_files(spark, tmp_path):
    import hashlib

    for n, b in (("a.bin", b"abc"), ("b.bin", b"\0")):
        (tmp_path / n).write_bytes(b)
    got = {r["path"].rsplit("/", 1)[1]: (r["bytes"], r["sha256"]) for r in packages.file_hashes(spark, str(tmp_path), "*.bin").collect()}
    assert got == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in (("a.bin", b"abc"), ("b.bin", b"\0"))}
    before, whole = spark.createDataFrame(packages.snapshot(spark, str(tmp_path), "*.bin").collect()), packages.folder_hash(spark, str(tmp_path), "*.bin")
    (tmp_path / "a.bin").write_bytes(b"abcd")
    (tmp_path / "b.bin").unlink()
    (tmp_path / "c.bin").write_bytes(b"c")
    changed = packages.changed_since(before, packages.snapshot(spark, str(tmp_path), "*.bin")).collect()
    assert {r["path"].rsplit("/", 1)[1]: r["reason"] for r in changed} == {"a.bin": "changed", "b.bin": "gone", "c.bin": "new"}
    assert packages.folder_hash(spark, str(tmp_path), "*.bin") != whole
    packages.write_json({"b": 1, "a": [2]}, tmp_path / "v.json")
    assert json.loads((tmp_path / "v.json").read_text()) == {"a": [2], "b": 1} and not list(tmp_path.glob("*.part"))
    with pytest.raises(ValueError):
        packages.write_json({"b": float("nan")}, tmp_path / "v.json")


def test_ids_and_vectors(spark, tmp_path):
    df = spark.createDataFrame([(bytearray("né".encode()),)], "m binary")
    assert packages.decoded_ids(df, "m").first()["m"] == "né"
    for b in (b"", b"a\0", b"\xff\xfe"):
        with pytest.raises(Exception, match="not an id|MALFORMED|malformed"):
            packages.decoded_ids(spark.createDataFrame([(bytearray(b),)], "m binary"), "m").collect()
    v = spark.createDataFrame([("a", [1.0, 2.0])], "id string, vector array<double>")
    packages.write_vectors(v, str(tmp_path / "v"), 2)
    assert spark.read.parquet(str(tmp_path / "v")).dtypes == [("id", "string"), ("vector", "array<float>")]
    with pytest.raises(ValueError):
        packages.write_vectors(v.limit(0), str(tmp_path / "w"), 2)
    with pytest.raises(Exception, match="has not 3 numbers"):
        packages.write_vectors(v, str(tmp_path / "x"), 3)


def test_tables_to_read(spark, tmp_path):
    df = spark.createDataFrame([(k, 50 - k, float(k % 3), [0.5, k / 10]) for k in range(7)], "gid bigint, molecule bigint, score double, scores array<double>")
    review.exported(df, str(tmp_path / "out"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(x["gid"] for x in lines) == list(range(7))
    best = review.write_review(df, str(tmp_path / "r"), 3)
    assert [r["gid"] for r in best.orderBy("rank").collect()] == [2, 5, 1]
    assert spark.read.option("header", True).csv(str(tmp_path / "r/ranks")).count() == 3
    assert review.candidate_table(df, [("a", 1), ("b", 5)]).filter("gid = 4").first().asDict() == {"gid": 4, "molecule": 46, "score": 1.0, "a": 0.4, "b": None}
    page = review.html_table(spark.createDataFrame([("x", "<b>"), ("y", None)], "kind string, name string"), "T", "kind")
    assert "&lt;b&gt;" in page and "<b>" not in page and page.count("<h2>") == 2
    with pytest.raises(ValueError):
        review.html_table(df, "T", "gid", 3)


def test_registry_rules(spark):
    active = spark.createDataFrame([("u", "a"), ("v", "a"), ("w", "z")], "user_id string, context_id string")
    owners = spark.createDataFrame([("u", "a")], "user_id string, context_id string")
    assert {tuple(r) for r in registry.access_faults(active, owners).collect()} == {("v", "a", "not the owner"), ("w", "z", "unknown")}
    paths = spark.createDataFrame([("/r/a",), ("/r",), ("/rx/a",), ("/r/../a",), ("/r/./a",), (None,)], "p string")
    assert [r[0] for r in paths.select(registry.within(F.col("p"), "/r/")).collect()] == [True, False, False, False, False, None]
    b = spark.createDataFrame([("r1", "x"), ("r1", "y")], "run_id string, sha256 string")
    c = spark.createDataFrame([("r1", "x"), ("r1", "z"), ("r2", "x"), ("a;b", "x"), (None, "x")], "run_id string, sha256 string")
    assert sorted((r["run_id"] or "", r["reason"]) for r in registry.receipt_faults(b, c).collect()) == [("", "unsafe name"), ("a;b", "unsafe name"), ("r1", "another bundle"), ("r2", "no bundle")]
