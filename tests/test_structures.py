"""Structure tables, receipts and registry read models."""

import pytest

from cairnrank.operators import registry, structures
from cairnrank.plans import receipts

HEAD = "loop_\n" + "".join(f"_atom_site.{c}\n" for c in ("group_PDB", "id", "type_symbol", "label_atom_id", "label_alt_id", "auth_comp_id", "auth_asym_id", "auth_seq_id", "Cartn_x", "Cartn_y", "Cartn_z", "pdbx_PDB_model_num"))
ATOMS = [("HETATM", "C", "C1", ".", "LIG", "A", 1, 10, 0, 0), ("HETATM", "O", "O1", ".", "LIG", "A", 1, 11, 0, 0), ("ATOM", "C", "CA", ".", "SER", "A", 5, 11, 0.5, 0), ("ATOM", "N", "N", ".", "SER", "A", 5, 11, 2.5, 0), ("ATOM", "H", "H", ".", "SER", "A", 5, 11, 3, 0)]


@pytest.fixture
def atoms(spark, tmp_path):
    lines = [f"{g} {i} {e} {a} {alt} {r} {c} {n} {x} {y} {z} 1" for i, (g, e, a, alt, r, c, n, x, y, z) in enumerate(ATOMS, 1)]
    (tmp_path / "s1.cif").write_text("data_S1\n" + HEAD + "\n".join(lines) + "\n#\n")
    return structures.mmcif_atoms(spark, str(tmp_path))


def test_atoms_and_contacts(spark, atoms):
    assert atoms.count() == 5
    (lig,) = structures.ligand_instances(atoms, ["lig"]).collect()
    assert (lig["structure_id"], lig["n_atoms"], lig["altloc"]) == ("s1", 2, "")
    protein = structures.protein_atoms(atoms)
    assert sorted((r["atom"], r["donor"], r["acceptor"]) for r in protein.collect()) == [("CA", False, False), ("N", True, False)]
    ligand = atoms.filter("residue = 'LIG'")
    (bond,) = structures.hydrogen_bonds(ligand, protein).collect()
    assert (bond["atom"], bond["kind"], bond["distance"]) == ("O1", "acceptor", 2.5)
    assert [r["number"] for r in structures.pocket_residues(protein, ligand).collect()] == [5]
    waters = spark.createDataFrame([(7, 11.0, -2.0, 1.0)], "id bigint, x double, y double, z double")
    assert structures.water_bridges(ligand, waters, protein, 5.0).count() == 1


def test_pose_checks(spark, atoms):
    poses = spark.createDataFrame([("t", 0, 10.0, 0.0, 0.0), ("t", 1, 11.0, 0.0, 0.0), ("far", 0, 900.0, 0.0, 0.0)], "task string, idx int, x double, y double, z double")
    got = {r["task"]: r for r in structures.pose_checks(poses, structures.protein_atoms(atoms), atoms.filter("residue = 'LIG'")).collect()}
    assert (got["t"]["near_fraction"], got["t"]["least_distance"], got["t"]["close"], got["t"]["severe"]) == (1.0, 0.5, 2, 2)
    assert (got["far"]["near_fraction"], got["far"]["least_distance"], got["far"]["severe"]) == (0.0, None, 0)
    deep = structures.exclusion(poses.selectExpr("*", "'C' as element"), structures.protein_atoms(atoms)).collect()
    assert [r["task"] for r in deep] == ["t"] and deep[0]["clashes"] == 2 and abs(deep[0]["deepest"] - 2.5) < 1e-9


def test_receipts(spark, tmp_path):
    rows, calls = spark.range(5).toDF("k"), []

    def work():
        calls.append(1)
        return rows.selectExpr("k", "k * 2 as v")

    run = lambda p, r=rows: receipts.checked_stage(str(tmp_path / "s"), {"rows": r}, {"p": p}, work, spark)
    assert [run(1)[1], run(1)[1], len(calls)] == [False, True, 1]
    with pytest.raises(ValueError, match="other inputs"):
        run(2)
    with pytest.raises(ValueError, match="other inputs"):
        run(1, spark.range(6).toDF("k"))
    rows.selectExpr("k", "k as v").write.mode("overwrite").parquet(str(tmp_path / "s/rows"))
    with pytest.raises(ValueError, match="have changed"):
        run(1)
    assert receipts.digest(rows) == receipts.digest(rows.repartition(3)) != receipts.digest(rows.union(rows))
    assert sorted(r["k"] for r in receipts.unfinished(rows, rows.filter("k < 3"), ["k"]).collect()) == [3, 4]


def test_registry(spark):
    tasks = spark.createDataFrame([(1, "a"), (2, "b")], "task_id int, name string")
    access = spark.createDataFrame([(1, "u", "viewer"), (2, "u", "owner"), (1, "w", "owner")], "task_id int, user_id string, role string")
    assert registry.accessible(tasks, access, "u").count() == 2 and [r["task_id"] for r in registry.accessible(tasks, access, "u", True).collect()] == [2]
    events = spark.createDataFrame([("r", 1, "created"), ("r", 2, "running"), ("s", 1, "created")], "run string, seq int, state string")
    assert {(r["run"], r["state"]) for r in registry.current(events, "run", ["seq"]).collect()} == {("r", "running"), ("s", "created")}
    assert [r["accepted"] for r in registry.first_locks(events, "run", ["seq"]).orderBy("run", "seq").collect()] == [True, False, True]
    runs = spark.createDataFrame([(128, "a", 0.96), (128, "b", 0.90), (256, "a", 0.99), (256, "b", 0.97)], "nprobe int, query_id string, recall double")
    assert registry.chosen_setting(runs, "nprobe", "recall", 2, 0.95).first()[0] == 256
    timed = spark.createDataFrame([("old", 4.0, True), ("new", 2.0, True), ("new", 9.0, False)], "variant string, seconds double, eligible boolean")
    assert {r["variant"]: r["speedup"] for r in registry.speedups(timed, "old").collect()} == {"old": 1.0, "new": 2.0}
    known = spark.createDataFrame([(1, "x")], "id int, name string")
    assert registry.ensured(known, spark.createDataFrame([("x",), ("y",), ("y",)], "name string"), "name").count() == 2
