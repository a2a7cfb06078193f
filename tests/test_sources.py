"""MOL2 text, structure writers, tables and streams."""

import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cairnrank.operators import overlay
from cairnrank.sources import mol2, tables
from cairnrank.streaming import incremental


def block(name, x, marker="@<TRIPOS>MOLECULE"):
    return f"{marker}\n{name}\n2 1 0 0 0\nSMALL\n\n@<TRIPOS>ATOM\n1 C1 {x} 0 0 C.3\n2 N1 {x + 1} 0 0 N.3\n@<TRIPOS>BOND\n1 1 2 1\n"


def test_mol2(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.mol2").write_text("dropped\n" + block("macro_A_conf0", 0) + block("macro_A_conf_1", 1, "@<tripos>molecule"))
    (tmp_path / "in/b.mol2").write_text(block("macro_B", 0) + block("macro_A_conf0", 5) + "@<TRIPOS>MOLECULE\nbad\n3 0\n")
    (tmp_path / "in/c.mol2").write_text("no record")
    (tmp_path / "in/d.txt").write_text(block("other", 0))
    rows = mol2.parsed(mol2.records(spark, str(tmp_path / "in"))).orderBy("path", "record_index")
    got = rows.collect()
    assert [(r["record_index"], r["molecule_name"], r["conformer_index"], r["error"]) for r in got] == [
        (0, "macro_A", 0, None), (1, "macro_A", 1, None), (0, "macro_B", 0, None), (1, "macro_A", 0, None), (2, "bad", 0, "atom count differs"),
    ]
    assert got[0]["topology_sha256"] == got[1]["topology_sha256"] != got[4]["topology_sha256"] and got[0]["content_sha256"] != got[1]["content_sha256"]
    assert got[0]["points"] == [[0.0, 0.0, 0.0], [1.0, 0.0, 0.0]] and got[4]["warnings"] == ["record_has_no_bonds"]
    known = spark.createDataFrame([], "molecule_name string, conformer_index int, content_sha256 string")
    report = mol2.import_report(rows, known)
    assert dict(report.groupBy("outcome").count().collect()) == {"inserted": 3, "invalid": 2}
    assert report.filter("error = 'Conformer index conflict'").count() == 1
    again = mol2.import_report(rows, rows.filter("error is null").dropDuplicates(["molecule_name", "conformer_index"]).filter("path like '%a.mol2' or name = 'macro_B'"))
    assert again.filter("outcome = 'duplicate'").count() == 3
    assert [r["path"].rsplit("/", 1)[1] for r in mol2.unmarked(spark, str(tmp_path / "in")).collect()] == ["c.mol2"]


def test_mol2_records_of_large_files(spark, tmp_path):
    """A file cut into many splits, with markers of another case and ends of line of another system."""
    blocks = [block(f"m{k}_conf{k % 3}", k, "@<tripos>Molecule" if k % 50 == 7 else "@<TRIPOS>MOLECULE") for k in range(400)]
    (tmp_path / "big.mol2").write_bytes(("head\n" + "".join(blocks)).replace("\n", "\r\n").encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = sorted((r["record_index"], r["raw_text"]) for r in mol2.records(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == list(enumerate(blocks))


def test_mol2_soundness(spark):
    """Digest of types and bonds by its definition, and what makes a record unsound."""
    good = block("a", 0)
    cases = {
        good: None, good.replace("2 1 0 0 0", "2"): "bad counts line", good.replace("2 1 0", "x 1 0"): "bad counts line", good.replace("2 1 0", "2 x 0"): "bad counts line",
        "@<TRIPOS>MOLECULE\nname\n0 0\n@<TRIPOS>BOND\n": "no atoms", "@<TRIPOS>MOLECULE\n": "missing name or counts", "@<TRIPOS>MOLECULE\n\n2 1\n": "missing name",
        good.replace("1 1 2 1", "1 1 2"): "short bond line", good.replace(" C.3", ""): "short atom line",
        good.replace("@<TRIPOS>BOND", "# 9 lines are atoms as well\n@<TRIPOS>BOND"): "atom count differs",
    }
    rows = spark.createDataFrame([("p", k, t) for k, t in enumerate(cases)], "path string, record_index bigint, raw_text string")
    got = {r["raw_text"]: r for r in mol2.parsed(rows).collect()}
    assert {t: r["error"] for t, r in got.items()} == cases
    assert got[good]["topology_sha256"] == hashlib.sha256(b"C.3|N.3||1-2:1").hexdigest() and got[good]["content_sha256"] == hashlib.sha256(good.encode()).hexdigest()


def test_structure_text(spark):
    s = spark.createDataFrame([("x", [[0.0, 0.0, 0.0]] * 9, [6] * 9, [[1, 2, 1]], [1] * 9)], "id string, points array<array<double>>, numbers array<int>, bonds array<array<int>>, charges array<int>")
    text = mol2.sdf_lines(s).first()["value"].split("\n")
    assert text[3].startswith("  9  1") and sum(x.startswith("M  CHG") for x in text) == 2 and text[-1] == "$$$$" and text[4][31] == "C"
    plain = mol2.sdf_lines(s.withColumn("charges", F.array_repeat(F.lit(0), 9))).first()["value"]
    assert "CHG" not in plain
    with pytest.raises(PySparkException):
        mol2.sdf_lines(s.withColumn("numbers", F.array_repeat(F.lit(99), 9))).collect()
    lines = mol2.pdb_lines(s).select(F.explode(F.split("value", "\n")).alias("value"))
    atoms = mol2.pdb_atoms(lines).collect()
    assert len(atoms) == 9 and atoms[0]["element"] == "X" and atoms[0]["x"] == 0.0


def test_tables(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("3\n1\n\n3\n")
    path = str(tmp_path / "ids.txt")
    assert sorted(r["gid"] for r in tables.distinct_ids(spark, path, "text").collect()) == [1, 3]
    assert [r["gid"] for r in tables.repeated(tables.ids(spark, path, "text")).collect()] == [3]
    (tmp_path / "bad.txt").write_text("-1\n")
    with pytest.raises(PySparkException):
        tables.ids(spark, str(tmp_path / "bad.txt"), "text").collect()
    corpus = spark.createDataFrame([(1, "a"), (2, "b")], "gid bigint, m string")
    wanted = spark.createDataFrame([(0, 2), (1, 9), (2, 2)], "place int, gid bigint")
    assert [tuple(r) for r in tables.fetched(wanted, corpus).orderBy("place").collect()] == [(0, 2, "b"), (1, 9, None), (2, 2, "b")]
    tables.write_jsonl(corpus, str(tmp_path / "out"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"gid":1,"m":"a"}', '{"gid":2,"m":"b"}']


def test_stream_appends_once_and_goes_on(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k bigint, v string").coalesce(1).write.parquet(source)
    stream = lambda: incremental.file_stream(spark, source, spark.read.parquet(source).schema, "*.parquet")
    checkpoint = incremental.appended(stream(), target, "k", str(tmp_path / "cp"))
    spark.createDataFrame([(2, "b"), (3, "c")], "k bigint, v string").coalesce(1).write.mode("append").parquet(source)
    incremental.appended(stream(), target, "k", checkpoint)
    incremental.appended(stream(), target, "k", checkpoint)
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(target).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_pocket_comparison(spark):
    data = [(s, r, float(r % 3 + d), float(r // 2), float(r)) for s, d in (("ref", 0), ("moved", 7)) for r in range(5)] + [("short", 0, 0.0, 0.0, 0.0)]
    coords = spark.createDataFrame(data, "structure_id string, residue bigint, x double, y double, z double")
    got = {r["structure_id"]: r for r in overlay.pocket_comparison(coords, "ref", [0, 1, 2, 3]).collect()}
    assert got["moved"]["rmsd"] < 1e-9 and got["moved"]["matched"] == 4 and got["short"]["status"] == "insufficient_overlap" and got["short"]["missing"] == 3
