"""Reviewing a finished search: its anchors, what meets them and how often, faults of its rows, and tables to read.

Anchors are few (a query has 64 at most); poses are as many as the search kept. Every count is a hash aggregate by query,
column and molecule, and nothing of a pose is collected.
"""

from __future__ import annotations

import html
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnrank.operators.structures import contacts

#: Scores from which on rows are counted.
LEVELS = (0.25, 0.5, 0.75)


def anchor_faults(anchors: DataFrame, mapping: DataFrame) -> DataFrame:
    """Anchors without a feature and features mapped for no anchor: query_id, anchor_id, reason."""
    own = anchors.select("query_id", "anchor_id", F.lit(True).alias("_a"))
    both = own.join(mapping.select("query_id", "anchor_id", "feature_index"), ["query_id", "anchor_id"], "full")
    reason = F.when(F.col("_a").isNull(), "no anchor").when(F.col("feature_index").isNull(), "no feature")
    return both.select("query_id", "anchor_id", reason.alias("reason")).filter("reason is not null")


def anchor_columns(anchors: DataFrame, mapping: DataFrame) -> DataFrame:
    """Anchors with feature_index and score_column, the place of their feature among the query's distinct ones, from 0.

    Anchors that share a feature share a column and aren't independent evidence. ``evidence_class`` says whether an angle
    (column ``angle``) was reported.
    """
    rows = anchors.join(mapping.select("query_id", "anchor_id", "feature_index"), ["query_id", "anchor_id"])
    place = F.dense_rank().over(Window.partitionBy("query_id").orderBy("feature_index")) - 1
    return rows.withColumns({"score_column": place.cast("int"), "evidence_class": F.when(F.col("angle").isNull(), "without_reported_angle").otherwise("with_reported_angle")})


def evidence_counts(poses: DataFrame, anchors: DataFrame, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """Rows and molecules that meet each anchor at each level: query_id, anchor_id, level, conformers, molecules.

    ``poses``: (query_id, molecule, scores, assignments), one score a column; a row meets an anchor if a feature is assigned
    (>= 0) and the score is a number of ``level`` or more. Anchors that nothing meets count 0.
    """
    cell = F.posexplode(F.arrays_zip(F.col("scores").alias("s"), F.col("assignments").alias("a"))).alias("score_column", "p")
    met = poses.select("query_id", "molecule", cell).filter((F.col("p.a") >= 0) & (F.col("p.s") >= min(levels)) & ~F.isnan("p.s"))
    each = met.groupBy("query_id", "score_column", "molecule").agg(*[F.count_if(F.col("p.s") >= t).alias(f"n{k}") for k, t in enumerate(levels)])
    pair = lambda k: F.struct(F.sum(f"n{k}").alias("conformers"), F.count_if(F.col(f"n{k}") > 0).alias("molecules")).alias(f"l{k}")
    whole = each.groupBy("query_id", "score_column").agg(*[pair(k) for k in range(len(levels))])
    rows = anchors.select("query_id", "anchor_id", "score_column").join(whole, ["query_id", "score_column"], "left")
    zero = lambda k, c: F.coalesce(F.col(f"l{k}.{c}"), F.lit(0).cast("bigint")).alias(c)
    cells = [F.struct(F.lit(t).alias("level"), zero(k, "conformers"), zero(k, "molecules")) for k, t in enumerate(levels)]
    return rows.select("query_id", "anchor_id", F.explode(F.array(*cells)).alias("x")).select("query_id", "anchor_id", "x.*")


def score_faults(rigid: DataFrame, side: DataFrame, width: int) -> DataFrame:
    """What makes annotations unfit for their poses, the first reason of each id: gid, reason.

    ``rigid``: (gid, molecule, conformer, score); ``side``: (gid, molecule, conformer, scores, assignments).
    """
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    bad = lambda ok: F.bool_or(~F.coalesce(ok, F.lit(False)))
    a = rigid.groupBy("gid").agg(F.count("*").alias("n"), F.min(F.struct("molecule", "conformer")).alias("x"), bad(number(F.col("score"))).alias("objective"))
    b = side.groupBy("gid").agg(
        F.count("*").alias("m"), F.min(F.struct("molecule", "conformer")).alias("y"), bad((F.size("scores") == width) & (F.size("assignments") == width)).alias("width"),
        bad(F.forall("scores", lambda s: number(s) & (s >= 0) & (s <= 1))).alias("score"),
    )
    rules = [
        ("missing pose", F.col("x").isNull()), ("missing annotation", F.col("y").isNull()), ("repeated id", (F.col("n") > 1) | (F.col("m") > 1)), ("another row", ~F.col("x").eqNullSafe(F.col("y"))),
        *((n, F.col(n)) for n in ("width", "score", "objective")),
    ]
    reason = F.coalesce(*[F.when(ok, n) for n, ok in rules])
    return a.join(b, "gid", "full").select("gid", reason.alias("reason")).filter("reason is not null")


def review_counts(retrieved: DataFrame, refined: DataFrame) -> DataFrame:
    """By query: conformers and molecules that were retrieved and refined, and refined rows that were not retrieved so.

    Both: (query_id, gid, molecule); each row counts, and a row was retrieved if one of its query, id and molecule was.
    """

    def counts(rows: DataFrame, name: str) -> DataFrame:
        each = rows.groupBy("query_id", "molecule").agg(F.count("*").alias("n"))
        return each.groupBy("query_id").agg(F.sum("n").alias(f"{name}_conformers"), F.count("*").alias(f"{name}_molecules"))

    stray = refined.join(retrieved, ["query_id", "gid", "molecule"], "left_anti").groupBy("query_id").agg(F.count("*").alias("strays"))
    out = counts(retrieved, "retrieved").join(counts(refined, "refined"), "query_id", "full").join(stray, "query_id", "left")
    return out.na.fill(0)


def union_counts(retrieved: DataFrame, refined: DataFrame) -> DataFrame:
    """One row: distinct conformers and molecules over all queries, retrieved and refined."""
    parts = [rows.select(F.lit(name).alias("of"), F.col(c).cast("string").alias("v")) for rows, c, name in ((retrieved, "gid", "retrieved_conformers"), (retrieved, "molecule", "retrieved_molecules"), (refined, "molecule", "refined_molecules"))]
    each = reduce(DataFrame.unionByName, parts).distinct()
    return each.agg(*[F.count_if(F.col("of") == n).alias(n) for n in ("retrieved_conformers", "retrieved_molecules", "refined_molecules")])


# --- hypotheses from geometry --------------------------------------------------------------------------------------

#: Side-chain atoms by residue: rings in cyclic order, hydrophobic atoms, and charged groups with their sign. Fixed values.
RINGS = {"PHE": ("CG CD1 CE1 CZ CE2 CD2",), "TYR": ("CG CD1 CE1 CZ CE2 CD2",), "HIS": ("CG ND1 CE1 NE2 CD2",), "TRP": ("CG CD1 NE1 CE2 CD2", "CD2 CE2 CZ2 CH2 CZ3 CE3")}
HYDROPHOBIC = {
    "ALA": "CB", "VAL": "CB CG1 CG2", "LEU": "CB CG CD1 CD2", "ILE": "CB CG1 CG2 CD1", "MET": "CB", "PRO": "CB CG", "PHE": "CB CG CD1 CD2 CE1 CE2 CZ", "TYR": "CB CG CD1 CD2 CE1 CE2",
    "TRP": "CB CG CD2 CE3 CZ2 CZ3 CH2", "LYS": "CB CG CD", "ARG": "CB CG", "GLU": "CB", "GLN": "CB",
}
CHARGED = {"LYS": (1, "NZ"), "ARG": (1, "NE NH1 NH2"), "ASP": (-1, "OD1 OD2"), "GLU": (-1, "OE1 OE2")}
METALS = ("ZN", "MG", "CA", "MN", "FE", "CO", "NI", "CU")
#: Interaction, feature type, class of partner, greatest distance. Fixed values.
RULES = (
    ("hydrophobic", 5, "hydrophobic", 4.0), ("salt_bridge", 3, "negative", 5.5), ("salt_bridge", 4, "positive", 5.5), ("pi_stacking", 6, "ring", 5.5), ("cation_pi", 6, "positive", 6.0),
    ("cation_pi", 3, "ring", 6.0), ("metal_coordination", 2, "metal", 3.0),
)
_OF = ["chain", "number", "residue"]


def _groups(atoms: DataFrame, groups: list[tuple[str, str, str]]) -> DataFrame:
    """Whole named groups of residues: their atoms' points in the named order, by residue; ``groups``: residue, class, atoms."""
    names = F.create_map(*[F.lit(v) for n, (_, _, g) in enumerate(groups) for v in (n, g)])
    numbers = [F.when(F.col("residue") == r, F.lit(n)) for n, (r, _, _) in enumerate(groups)]
    rows = atoms.select(*_OF, "atom", "x", "y", "z", F.explode(F.array_compact(F.array(*numbers))).alias("group"))
    rows = rows.withColumn("place", F.array_position(F.split(names[F.col("group")], " "), F.col("atom"))).filter("place > 0")
    kind = F.create_map(*[F.lit(v) for n, (_, k, _) in enumerate(groups) for v in (n, k)])
    size = F.create_map(*[F.lit(v) for n, (_, _, g) in enumerate(groups) for v in (n, len(g.split()))])
    rows = rows.groupBy(*_OF, "group").agg(F.sort_array(F.collect_list(F.struct("place", "x", "y", "z"))).alias("p"))
    return rows.filter(F.size("p") == size[F.col("group")]).select(*_OF, kind[F.col("group")].alias("class"), F.replace(names[F.col("group")], F.lit(" "), F.lit("/")).alias("atom"), "p")


def _mean(c: str) -> Column:
    return F.aggregate("p", F.lit(0.0), lambda s, q: s + q[c]) / F.size("p")


def partners(atoms: DataFrame) -> DataFrame:
    """What features may meet in a structure: chain, number, residue, atom, class, x, y, z, and a ring's normal (nx, ny, nz).

    ``atoms``: (chain, number, residue, atom, symbol, x, y, z). A charged group or ring counts only if all its atoms are there.
    Its normal is the sum of the cross products of its points in cyclic order, which is exact for a flat ring whose sides don't cross.
    """
    greasy = F.create_map(*[F.lit(v) for r, g in HYDROPHOBIC.items() for v in (r, g)])
    none = [F.lit(None).cast("double").alias(c) for c in ("nx", "ny", "nz")]
    points = [F.col(c).cast("double").alias(c) for c in "xyz"]
    single = lambda ok, name: atoms.filter(ok).select(*_OF, "atom", F.lit(name).alias("class"), *points, *none)
    out = single(F.array_contains(F.split(greasy[F.col("residue")], " "), F.col("atom")), "hydrophobic").unionByName(single(F.upper("symbol").isin(*METALS), "metal"))
    groups = [(r, "ring", g) for r, gs in RINGS.items() for g in gs] + [(r, "positive" if s > 0 else "negative", g) for r, (s, g) in CHARGED.items()]
    rows = _groups(atoms, groups).withColumns({c: _mean(c) for c in "xyz"})

    def normal(a: str, b: str) -> Column:
        step = lambda q, n: (q[a] - F.col(a)) * (F.col("p")[(n + 1) % F.size("p")][b] - F.col(b)) - (q[b] - F.col(b)) * (F.col("p")[(n + 1) % F.size("p")][a] - F.col(a))
        return F.aggregate(F.transform("p", step), F.lit(0.0), lambda s, v: s + v)

    rows = rows.withColumns({"nx": normal("y", "z"), "ny": normal("z", "x"), "nz": normal("x", "y")})
    size = F.sqrt(sum((F.col(c) * F.col(c) for c in ("nx", "ny", "nz")), F.lit(0.0)))
    rows = rows.withColumns({c: F.when((F.col("class") == "ring") & (size > 0), F.col(c) / size) for c in ("nx", "ny", "nz")})
    return out.unionByName(rows.select(*out.columns))


def hypotheses(features: DataFrame, found: DataFrame) -> DataFrame:
    """Which partner may explain which feature of a query, by ``RULES``: the nearest of each residue and rule.

    ``features``: (query_id, feature_index, type, kind, x, y, z, dx, dy, dz), kind 2 for an axis; ``found``: ``partners``. A
    ring meets a ring if their planes are within 30 degrees of parallel or of upright and one lies 2 or less off the other's
    axis. These are hypotheses of geometry: query_id, feature_index, interaction, chain, number, residue, atom, distance, angle.
    Features and partners meet in an equi-join on grid cells.
    """
    rules = features.sparkSession.createDataFrame(RULES, "interaction string, type int, class string, most double")
    f = features.select("query_id", "feature_index", F.col("type").cast("int").alias("type"), "kind", "x", "y", "z", "dx", "dy", "dz")
    both = contacts(f, found, max(r[3] for r in RULES))
    both = both.join(F.broadcast(rules), (F.col("a_type") == F.col("type")) & (F.col("b_class") == F.col("class"))).filter("distance <= most")  # seven rows
    dot = lambda p, q: sum((F.col(u) * F.col(v) for u, v in zip(p, q, strict=True)), F.lit(0.0))
    own, other, delta = ("a_dx", "a_dy", "a_dz"), ("b_nx", "b_ny", "b_nz"), ("_x", "_y", "_z")
    both = both.withColumns({f"_{c}": F.col(f"a_{c}") - F.col(f"b_{c}") for c in "xyz"})
    angle = F.degrees(F.acos(F.least(F.abs(dot(own, other)), F.lit(1.0))))
    off = lambda axis: F.sqrt(F.greatest(dot(delta, delta) - F.pow(dot(delta, axis), 2), F.lit(0.0)))
    stacked = (F.col("a_kind") == 2) & ((angle <= 30) | (angle >= 60)) & (F.least(off(own), off(other)) <= 2)
    both = both.filter((F.col("interaction") != "pi_stacking") | F.coalesce(stacked, F.lit(False)))
    best = F.min(F.struct("distance", F.col("b_atom").alias("atom"), F.when(F.col("interaction") == "pi_stacking", angle).alias("angle"))).alias("x")
    # hydrophobic atoms: the nearest of a residue; other classes: each group of its own
    part = F.when(F.col("interaction") == "hydrophobic", "").otherwise(F.col("b_atom"))
    keys = [F.col("a_query_id").alias("query_id"), F.col("a_feature_index").alias("feature_index"), "interaction", *[F.col(f"b_{c}").alias(c) for c in _OF], part.alias("_part")]
    return both.groupBy(*keys).agg(best).select("query_id", "feature_index", "interaction", *_OF, "x.atom", "x.distance", "x.angle")


def classified_anchors(anchors: DataFrame, extra: DataFrame) -> DataFrame:
    """Anchors and hypotheses together with one set of score columns: query_id, anchor_id, interaction, feature_index, score_column.

    ``anchors``: (query_id, anchor_id, feature_index), hydrogen bonds; ``extra``: ``hypotheses``. Score the columns' features by
    ``overlay.annotated`` on the poses as they are, then count by ``evidence_counts``.
    """
    name = F.concat_ws(":", F.concat(F.lit("F"), F.col("feature_index").cast("string")), "interaction", "chain", F.col("number").cast("string"), "atom")
    rows = anchors.select("query_id", "anchor_id", F.lit("hydrogen_bond").alias("interaction"), "feature_index")
    rows = rows.unionByName(extra.select("query_id", name.alias("anchor_id"), "interaction", "feature_index"))
    return rows.withColumn("score_column", (F.dense_rank().over(Window.partitionBy("query_id").orderBy("feature_index")) - 1).cast("int"))


# --- tables to read ------------------------------------------------------------------------------------------------


def candidate_table(poses: DataFrame, anchors: list[tuple[str, int]]) -> DataFrame:
    """Poses of one query with a column for each anchor (name, score column)."""
    return poses.select("gid", "molecule", "score", *[F.get("scores", F.lit(k)).alias(name) for name, k in anchors])


def exported(representatives: DataFrame, path: str) -> None:
    """Chosen rows as JSON lines in the order of their ids: files in order of ranges, each sorted."""
    representatives.repartitionByRange("gid").sortWithinPartitions("gid").select(F.to_json(F.struct(*sorted(representatives.columns))).alias("value")).write.text(path)


def write_review(poses: DataFrame, folder: str, most: int) -> DataFrame:
    """A query's best ``most`` poses by score (ties by id) as CSV with a header, and the rows written."""
    rows = poses.orderBy(F.desc("score"), F.asc("gid")).limit(most)
    rows = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc("gid"))))  # ``most`` bounds what is sorted
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).coalesce(1).write.option("header", True).csv(f"{folder}/ranks")
    return rows


def html_table(rows: DataFrame, title: str, section: str, most: int = 10_000) -> str:
    """A small table as an HTML page, a section for each value of a column; more than ``most`` rows are an error."""
    cols = [c for c in rows.columns if c != section]
    held = rows.orderBy(section, *cols).limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"a page holds {most} rows at most; write the table instead")
    cell = lambda tag, v: f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>"
    parts = [f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title>", cell("h1", title)]
    for name in sorted({str(r[section]) for r in held}):
        parts += [cell("h2", name), "<table><tr>" + "".join(cell("th", c) for c in cols) + "</tr>"]
        parts += ["<tr>" + "".join(cell("td", r[c]) for c in cols) + "</tr>" for r in held if str(r[section]) == name] + ["</table>"]
    return "\n".join(parts)
