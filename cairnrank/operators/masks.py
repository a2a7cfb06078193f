"""Hit masks, stage funnels and selections over scored poses.

A condition holds for a pose or not: all and any are judged within one pose, and masks of different poses are joined only
where a report says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnrank.operators.ranking import top, top_within


def unnested(counts: DataFrame, bits: int, names: list[str]) -> DataFrame:
    return counts.select(*names, F.explode(F.array(*[F.struct(F.lit(j).cast("bigint").alias("bit"), F.col(f"b{j}").alias("n")) for j in range(bits)])).alias("x")).select(*names, "x.bit", "x.n")


def bit_counts(poses: DataFrame, molecule: str, mask: str, bits: int) -> DataFrame:
    """Molecules and poses by bit: a molecule counts if any of its poses has it (masks joined by OR)."""
    if not 0 < bits < 64:
        raise ValueError("a mask has 1 to 63 bits")
    has = lambda j: F.col(mask).bitwiseAND(F.lit(1 << j).cast("bigint")) != 0
    whole = poses.groupBy(molecule).agg(F.bit_or(mask).alias(mask)).agg(*[F.count_if(has(j)).alias(f"b{j}") for j in range(bits)])
    each = poses.agg(*[F.count_if(has(j)).alias(f"b{j}") for j in range(bits)])
    return unnested(whole, bits, []).withColumnRenamed("n", "molecules").join(unnested(each, bits, []).withColumnRenamed("n", "poses"), "bit")


def mask_histogram(poses: DataFrame, molecule: str, mask: str) -> DataFrame:
    """Molecules that have a pose with exactly that mask."""
    return poses.groupBy(mask).agg(F.countDistinct(molecule).alias("molecules"))


def union_masks(poses: DataFrame, molecule: str, mask: str) -> DataFrame:
    """Bits that some pose of a molecule has, not at once perhaps."""
    return poses.groupBy(molecule).agg(F.bit_or(mask).alias("union_mask"), F.count("*").alias("poses"))


def best_by_mask(poses: DataFrame, molecule: str, mask: str, quality: str, gid: str = "gid") -> DataFrame:
    """A molecule's best pose for each exact mask but 0: quality desc, id asc."""
    best = F.max(F.struct(F.col(quality).alias("q"), (-F.col(gid)).alias("g"))).alias("b")
    return poses.filter(F.col(mask) != 0).groupBy(molecule, mask).agg(best).select(molecule, mask, F.col("b.q").alias(quality), (-F.col("b.g")).alias(gid))


def first_failure(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that doesn't hold, ``passed`` if all do; an undecided rule fails."""
    out = F.lit("passed")
    for name, ok in reversed(rules):
        out = F.when(F.coalesce(ok, F.lit(False)), out).otherwise(name)
    return out


def stage_level(rules: list[Column]) -> Column:
    """How many rules hold before the first that doesn't."""
    out = F.lit(len(rules))
    for k in range(len(rules) - 1, -1, -1):
        out = F.when(F.coalesce(rules[k], F.lit(False)), out).otherwise(k)
    return out.cast("bigint")


def stage_histogram(rows: DataFrame, molecule: str, stage: str, stages: int) -> DataFrame:
    """Rows and molecules that reach each stage or a later one; a molecule's stage is its rows' greatest."""
    counted = lambda c: [F.count_if(F.col(c) >= j).alias(f"b{j}") for j in range(stages + 1)]
    each = unnested(rows.agg(*counted(stage)), stages + 1, []).withColumnRenamed("n", "rows")
    whole = unnested(rows.groupBy(molecule).agg(F.max(stage).alias(stage)).agg(*counted(stage)), stages + 1, []).withColumnRenamed("n", "molecules")
    return each.join(whole, "bit").withColumnRenamed("bit", "stage")


def pass_counts(rows: DataFrame, hits: list[Column]) -> DataFrame:
    """Rows that meet each condition, and that meet it and all before it."""
    alone = unnested(rows.agg(*[F.count_if(h).alias(f"b{j}") for j, h in enumerate(hits)]), len(hits), []).withColumnRenamed("n", "alone")
    so_far, cols = F.lit(True), []
    for j, h in enumerate(hits):
        so_far = so_far & h
        cols.append(F.count_if(so_far).alias(f"b{j}"))
    return alone.join(unnested(rows.agg(*cols), len(hits), []).withColumnRenamed("n", "cumulative"), "bit")


def pose_passes(scores: str, assignments: str, columns: list[int], least: float, policy: str) -> Column:
    """Whether one pose meets ``all`` or ``any`` of the chosen anchors: score of ``least`` or more, and assigned (>= 0)."""
    if policy not in ("all", "any") or not columns or len(set(columns)) != len(columns) or len(columns) > 64 or isinstance(least, bool) or not 0 < least <= 1:
        raise ValueError("1 to 64 distinct anchors, all or any, and a score in (0, 1]")
    pairs = F.arrays_zip(F.array(*[F.col(scores)[k] for k in columns]).alias("s"), F.array(*[F.col(assignments)[k] for k in columns]).alias("a"))
    test = lambda p: (p["s"] >= least) & (p["a"] >= 0)
    return F.forall(pairs, test) if policy == "all" else F.exists(pairs, test)


def selection(poses: DataFrame, passes: Column, cap: int, molecule: str = "molecule", score: str = "score", gid: str = "gid") -> DataFrame:
    """Passing poses: each molecule's best by (score desc, id asc), then the ``cap`` best."""
    by = [F.desc(score), F.asc(gid)]
    return top(top_within(poses.filter(passes), 1, by, [molecule], "_one").drop("_one"), cap, by)
