"""MOL2 text: a record source over files, a validating parser, and writers of structure files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnrank.functions.scalars import split_conformer
from cairnrank.operators.ranking import ranked_by_range
from cairnrank.session import staged

MARKER = "@<TRIPOS>MOLECULE"
#: Atomic numbers to symbols for the writers. Fixed values.
ELEMENTS = {1: "H", 5: "B", 6: "C", 7: "N", 8: "O", 9: "F", 14: "Si", 15: "P", 16: "S", 17: "Cl", 35: "Br", 53: "I"}
#: A marker's line, whatever its case.
_MARKED = r"(?im)(?=^[ \t]*@<TRIPOS>MOLECULE[ \t]*$)"


def _chunks(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    """(path, block, id, value): text between markers as they are mostly written, which readers split by bytes."""
    text = spark.read.option("lineSep", MARKER).option("pathGlobFilter", "*.[mM][oO][lL]2").option("recursiveFileLookup", str(recursive).lower()).text(path)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")


def records(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, record_index, raw_text) of all ``.mol2`` files at a path, in the order of each file; line ends are newlines.

    The marker is the reader's line separator, so a file is read by many tasks, none of which holds more than a record;
    markers of another case are found inside what it yields. Text before a file's first marker is dropped.
    """
    chunks = ranked_by_range(_chunks(spark, path, recursive), "path", [F.asc("block"), F.asc("id")], "chunk")
    text = F.when(F.col("chunk") > 1, F.concat(F.lit(MARKER), "value")).otherwise(F.col("value"))
    pieces = F.filter(F.split(F.regexp_replace(text, "\r\n?", "\n"), _MARKED), lambda x: F.upper(F.ltrim(x)).startswith(MARKER))
    rows = chunks.select("path", "chunk", F.posexplode(pieces).alias("at", "raw_text"))
    rows = staged(rows, "records")
    usual = rows.groupBy().agg(F.count_if((F.col("at") > 0) | (F.col("chunk") == 1)).alias("n")).first()["n"] == 0
    if usual:  # a record for each chunk but the first
        return rows.select("path", (F.col("chunk") - 2).alias("record_index"), "raw_text")
    return ranked_by_range(rows, "path", [F.asc("chunk"), F.asc("at")], "n").select("path", (F.col("n") - 1).alias("record_index"), "raw_text")


def unmarked(spark: SparkSession, path: str) -> DataFrame:
    """Files that have text but no record."""
    chunks = _chunks(spark, path, True).groupBy("path").agg(F.count("*").alias("n"), F.max(F.col("value").rlike(_MARKED)).alias("other"))
    return chunks.filter("n = 1 and not other").select("path")


def parsed(rows: DataFrame) -> DataFrame:
    """Records with name, counts, digests, warnings, and ``error`` (null if the record is sound). No Python.

    Sections are found by their headers; atoms need six fields and bonds four, and their numbers must be as counted and
    given as whole numbers; a record without atoms is unsound. The topology digest covers atom types and bonds (``first-second:type``), not
    coordinates. A repeated section goes on where it stopped.
    """
    lines = F.transform(F.split("raw_text", "\r?\n"), lambda x: F.trim(x))
    head = lambda x: F.upper(x).startswith("@<TRIPOS>")
    rows = rows.withColumn("_lines", lines)
    heads = F.filter(F.transform("_lines", lambda x, i: F.when(head(x), F.struct(F.upper(x).alias("h"), i.alias("i")))), lambda x: x.isNotNull())
    rows = rows.withColumn("_heads", heads)

    def section(name: str, blank: bool):
        """Lines of all sections with the name; ``blank``: empty ones too."""
        stop = lambda k: F.coalesce(F.get("_heads", k + 1)["i"], F.size("_lines"))
        part = lambda h, k: F.when(h["h"] == f"@<TRIPOS>{name}", F.slice("_lines", h["i"] + 2, stop(k) - h["i"] - 1)).otherwise(F.array().cast("array<string>"))
        every = F.flatten(F.transform("_heads", part))
        return every if blank else F.filter(every, lambda x: x != "")

    words = lambda x: F.split(x, r"\s+")
    rows = rows.withColumns({"_m": section("MOLECULE", True), "_a": F.transform(section("ATOM", False), words), "_b": F.transform(section("BOND", False), words)})
    counts = words(F.get("_m", F.lit(1)))
    rows = rows.withColumns({"name": F.get("_m", F.lit(0)), "atom_count": F.get(counts, F.lit(0)).try_cast("int"), "bond_count": F.get(counts, F.lit(1)).try_cast("int")})
    error = (
        F.when(F.size("_m") < 2, "missing name or counts").when(F.col("name") == "", "missing name").when(F.col("atom_count").isNull() | F.col("bond_count").isNull(), "bad counts line")
        .when(F.size("_a") != F.col("atom_count"), "atom count differs").when(F.size("_a") == 0, "no atoms").when(F.size("_b") != F.col("bond_count"), "bond count differs")
        .when(F.exists("_a", lambda x: F.size(x) < 6), "short atom line").when(F.exists("_b", lambda x: F.size(x) < 4), "short bond line")
    )
    atoms = F.concat_ws("|", F.transform("_a", lambda x: F.get(x, F.lit(5))))
    bonds = F.concat_ws("|", F.transform("_b", lambda x: F.concat(F.get(x, F.lit(1)), F.lit("-"), F.get(x, F.lit(2)), F.lit(":"), F.get(x, F.lit(3)))))
    molecule, conformer = split_conformer(F.col("name"))
    return rows.select(
        "path", "record_index", "name", molecule.alias("molecule_name"), conformer.alias("conformer_index"), "atom_count", "bond_count", "raw_text",
        F.sha2("raw_text", 256).alias("content_sha256"), F.sha2(F.concat_ws("||", atoms, bonds), 256).alias("topology_sha256"),
        F.when(F.col("bond_count") == 0, F.array(F.lit("record_has_no_bonds"))).otherwise(F.array().cast("array<string>")).alias("warnings"), error.alias("error"),
        F.transform("_a", lambda x: F.array(*[F.get(x, F.lit(k)).try_cast("double") for k in (2, 3, 4)])).alias("points"),
    )


def import_report(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Outcome of each parsed record against known ones (molecule_name, conformer_index, content_sha256).

    ``invalid`` (unsound, or another content for its molecule and index), ``duplicate`` or ``inserted``.
    """
    from cairnrank.operators.records import imported

    bad = rows.filter("error is not null").select("path", "record_index", F.lit("invalid").alias("outcome"), "error")
    good = imported(rows.filter("error is null"), known, ["molecule_name", "conformer_index"], "content_sha256", ["path", "record_index"])
    clash = F.when(F.col("outcome") == "conflict", "Conformer index conflict")
    good = good.select("path", "record_index", F.when(F.col("outcome") == "conflict", "invalid").otherwise(F.col("outcome")).alias("outcome"), clash.alias("error"))
    return bad.unionByName(good)


def sdf_lines(structures: DataFrame) -> DataFrame:
    """(id, points array<array<double>>, numbers array<int>, bonds array<array<int>>, charges array<int>) to V2000 text.

    Charges other than 0 stand in ``M  CHG`` lines of eight at most; an unknown element is an error.
    """
    element = F.create_map(*[F.lit(x) for kv in ELEMENTS.items() for x in kv])
    atom = lambda p, i: F.format_string("%10.4f%10.4f%10.4f %-3s 0  0  0  0  0  0  0  0  0  0  0  0", p[0], p[1], p[2], F.coalesce(element[F.get("numbers", i)], F.raise_error(F.lit("unknown element"))))
    charged = F.filter(F.transform("charges", lambda c, i: F.struct((i + 1).alias("i"), c.alias("c"))), lambda x: x["c"] != 0)
    groups = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(charged) / 8).cast("int") - 1))
    chunk = lambda g: F.slice(charged, g * 8 + 1, 8)
    chg = F.filter(F.transform(groups, lambda g: F.when(F.size(chunk(g)) > 0, F.concat(F.format_string("M  CHG%3d", F.size(chunk(g))), F.concat_ws("", F.transform(chunk(g), lambda x: F.format_string(" %3d %3d", x["i"], x["c"])))))), lambda x: x.isNotNull())
    lines = F.flatten(F.array(
        F.array(F.col("id").cast("string"), F.lit("  cairnrank"), F.lit(""), F.format_string("%3d%3d  0  0  0  0  0  0  0  0999 V2000", F.size("points"), F.size("bonds"))),
        F.transform("points", atom), F.transform("bonds", lambda b: F.format_string("%3d%3d%3d  0", b[0], b[1], b[2])), chg,
        F.array(F.lit("M  END"), F.lit("> <id>"), F.col("id").cast("string"), F.lit(""), F.lit("$$$$")),
    ))
    return structures.select("id", F.concat_ws("\n", lines).alias("value"))


def pdb_lines(clouds: DataFrame) -> DataFrame:
    """(id, points) to PDB text of generic X atoms."""
    atom = lambda p, i: F.format_string("HETATM%5d  X   UNK A   1    %8.3f%8.3f%8.3f  1.00  0.00           X", i + 1, p[0], p[1], p[2])
    return clouds.select("id", F.concat_ws("\n", F.transform("points", atom), F.lit("END")).alias("value"))


def pdb_atoms(lines: DataFrame) -> DataFrame:
    """Fixed-width ATOM and HETATM lines (column ``value``) to columns; a missing element is the name's first letter."""
    v = lambda a, n: F.trim(F.substring("value", a, n))
    rows = lines.filter(F.substring("value", 1, 6).isin("ATOM  ", "HETATM"))
    guess = F.upper(F.regexp_extract(v(13, 4), "([A-Za-z])", 1))
    return rows.select(
        v(1, 6).alias("record"), v(13, 4).alias("name"), v(18, 3).alias("residue"), v(22, 1).alias("chain"), v(23, 4).cast("int").alias("number"),
        *[v(a, 8).cast("double").alias(c) for c, a in (("x", 31), ("y", 39), ("z", 47))], F.when(v(77, 2) == "", guess).otherwise(F.upper(v(77, 2))).alias("element"),
    )
