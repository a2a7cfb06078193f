"""Registry relations: access, projects, campaigns, runs and locks as append-only event tables and their read models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States and what may follow them. Fixed values.
CAMPAIGN = {"draft": ("target_set",), "target_set": ("structures_review",), "structures_review": ("structure_selected",)}
RUN = {"created": ("submitted", "cancelled"), "submitted": ("running", "failed", "cancelled"), "running": ("completed", "failed", "cancelled")}


def accessible(tasks: DataFrame, access: DataFrame, user: str, write: bool = False) -> DataFrame:
    """Tasks that a user may see, or change (viewers may not)."""
    own = access.filter(F.col("user_id") == user)
    if write:
        own = own.filter(F.col("role") != "viewer")
    return tasks.join(own.select("task_id", "role"), "task_id")


def ensured(known: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Known rows, and new ones for names that aren't there, each once."""
    return known.unionByName(names.select(key).distinct().join(known.select(key), key, "left_anti"), allowMissingColumns=True)


def current(events: DataFrame, entity: str, order: list[str]) -> DataFrame:
    """Each entity's last event: a hash aggregate."""
    last = F.max(F.struct(*order, *[F.col(c) for c in events.columns if c not in (entity, *order)])).alias("e")
    return events.groupBy(entity).agg(last).select(entity, "e.*")


def first_locks(events: DataFrame, entity: str, order: list[str]) -> DataFrame:
    """The first lock of each entity stands; later ones count as refused."""
    n = F.row_number().over(Window.partitionBy(entity).orderBy(*order))
    return events.withColumn("accepted", n == 1)


def candidates_by_resolution(rows: DataFrame) -> DataFrame:
    """Structures by campaign in reading order: resolution, unknown last, then id."""
    w = Window.partitionBy("campaign_id").orderBy(F.asc_nulls_last("resolution"), "pdb_id")
    return rows.withColumn("place", F.row_number().over(w).cast("bigint"))


def comparison_faults(members: DataFrame) -> DataFrame:
    """Comparison sets with under two members, or an excluded member without a reason."""
    return members.groupBy("set_id").agg(F.count_if(~F.col("excluded")).alias("members"), F.count_if(F.col("excluded") & (F.coalesce(F.col("reason"), F.lit("")) == "")).alias("unexplained")).filter("members < 2 or unexplained > 0")


def review_faults(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims that refer to evidence that isn't there."""
    return claims.join(evidence.select("evidence_id"), "evidence_id", "left_anti")


def conflicting_records(records: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Keys whose records differ, with the digests they have."""
    return records.groupBy(*keys).agg(F.sort_array(F.collect_set(digest)).alias("digests")).filter(F.size("digests") > 1)


def chosen_setting(runs: DataFrame, setting: str, value: str, queries: int, gate: float) -> DataFrame:
    """The least setting that has every query once and no value under the gate."""
    ok = runs.groupBy(setting).agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("q"), F.min(value).alias("least"))
    return ok.filter((F.col("n") == queries) & (F.col("q") == queries) & (F.col("least") >= gate)).agg(F.min(setting).alias(setting))


def speedups(runs: DataFrame, baseline: str) -> DataFrame:
    """Median seconds of eligible runs by variant, and how many times faster than the baseline it is."""
    mid = runs.filter("eligible").groupBy("variant").agg(F.median("seconds").alias("seconds"), F.count("*").alias("runs"))
    base = mid.filter(F.col("variant") == baseline).select(F.col("seconds").alias("base"))
    return mid.join(F.broadcast(base.limit(1)), F.lit(True), "left").select("variant", "runs", "seconds", (F.col("base") / F.col("seconds")).alias("speedup"))


def active_context(events: DataFrame, order: list[str]) -> DataFrame:
    """What each user works in: the last of the events (user_id, action, context_id), unless it is ``deactivate``."""
    last = F.max(F.struct(*order, "action", "context_id")).alias("e")
    return events.groupBy("user_id").agg(last).filter("e.action = 'activate'").select("user_id", F.col("e.context_id").alias("context_id"))


def access_faults(active: DataFrame, owners: DataFrame) -> DataFrame:
    """Active contexts (user_id, context_id) that the user doesn't own, or that aren't there: user_id, context_id, reason."""
    own = owners.groupBy("context_id").agg(F.min("user_id").alias("owner"))
    reason = F.when(F.col("owner").isNull(), "unknown").when(F.col("owner") != F.col("user_id"), "not the owner")
    return active.join(own, "context_id", "left").select("user_id", "context_id", reason.alias("reason")).filter("reason is not null")


def context_summary(contexts: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """Contexts with the number of rows that each named table has for them, 0 if none."""
    for name, rows in parts.items():
        contexts = contexts.join(rows.groupBy("context_id").agg(F.count("*").alias(name)), "context_id", "left")
    return contexts.na.fill(0, list(parts))


def within(path: Column, root: str) -> Column:
    """Whether a path lies in a root by its names alone: an absolute path under it, without a step back."""
    base = root.rstrip("/") + "/"
    return path.startswith(base) & ~F.exists(F.split(path, "/"), lambda p: p.isin(".", ".."))


def request_faults(requests: DataFrame, allowed: tuple[str, ...], denied: tuple[str, ...]) -> DataFrame:
    """Review requests (request_id, data_classes) that may not be sent: a class that is denied, or not allowed, or none at all."""
    deny, allow = (F.array(*map(F.lit, names)).cast("array<string>") for names in (denied, allowed))
    classes = F.coalesce("data_classes", F.array().cast("array<string>"))
    reason = F.when(F.size(classes) == 0, "no class").when(F.arrays_overlap(classes, deny), "denied").when(F.size(F.array_except(classes, allow)) > 0, "not allowed")
    return requests.select("request_id", reason.alias("reason")).filter("reason is not null")


def verdict_faults(asked: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Subjects (request_id, subject_id) without exactly one verdict, or judged but not asked: request_id, subject_id, verdicts."""
    n = verdicts.groupBy("request_id", "subject_id").agg(F.count("*").alias("verdicts"))
    both = asked.select("request_id", "subject_id", F.lit(True).alias("_asked")).distinct().join(n, ["request_id", "subject_id"], "full").na.fill(0, ["verdicts"])
    return both.filter(F.col("_asked").isNull() | (F.col("verdicts") != 1)).drop("_asked")


def receipt_faults(bundles: DataFrame, receipts: DataFrame) -> DataFrame:
    """Receipts (run_id, sha256) that match no exported bundle of their run, and names with other than letters, digits, . _ -."""
    own = bundles.groupBy("run_id").agg(F.collect_set("sha256").alias("exported"))
    safe = F.col("run_id").rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$")
    reason = F.when(~F.coalesce(safe, F.lit(False)), "unsafe name").when(F.col("exported").isNull(), "no bundle").when(~F.array_contains("exported", F.col("sha256")), "another bundle")
    return receipts.join(own, "run_id", "left").select("run_id", "sha256", reason.alias("reason")).filter("reason is not null")


def queued(events: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The ``n`` jobs (job_id, state) that have waited longest: those whose last event is ``queued``, oldest first."""
    return current(events, "job_id", order).filter("state = 'queued'").orderBy(*order, "job_id").limit(n)
