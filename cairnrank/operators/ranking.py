"""Ranking operators: merges, schedules, collapse, caps, ranks and their comparison.

Every order ends in a unique id, so results are the same in any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnrank.session import staged

CHANNELS = ("baseline", "strict", "balanced", "loose")

#: Counts by key and partition that are broadcast, at most.
MOST_PARTS = 500_000


def ranked(df: DataFrame, by: list[Column], within: list[str] | None = None, name: str = "rank") -> DataFrame:
    """1-based row numbers by ``by``, within groups if given."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*(within or [])).orderBy(*by)).cast("bigint"))


def ranked_globally(df: DataFrame, by: list[Column], name: str = "rank") -> DataFrame:
    """1-based numbers of all rows in an order, without bringing them to one task.

    Rows are dealt by ranges and sorted there; a row's number is its place in its range plus the rows of those before, of
    which there is one count a partition. The order must be total.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = staged(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()), "ranked")
    rows = rows.withColumn("_part", F.shiftright("_id", 33))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part")
    return rows.withColumn(name, F.col("_id").bitwiseAND((1 << 33) - 1) + 1 + F.col("_before")).drop("_id", "_part", "_before")


def ranked_by_range(df: DataFrame, key: str, by: list[Column], name: str = "rank", count: str | None = None) -> DataFrame:
    """1-based places of rows within their key, and the key's rows as ``count``, without bringing a key to one task.

    Rows are dealt by ranges of the key and the order, so a large key has several partitions; its rows before a partition
    come from one count for each key and partition. The order must be total within a key.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, F.asc(key), *by).sortWithinPartitions(F.asc(key), *by).withColumn("_id", F.monotonically_increasing_id())
    rows = staged(rows, "ranked").withColumn("_part", F.shiftright("_id", 33))
    parts = rows.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_of")).agg(F.count("*").alias("_rows"), F.min("_id").alias("_first"))
    w = Window.partitionBy("_key")
    before = F.coalesce(F.sum("_rows").over(w.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_key", "_of", "_first", before.alias("_before"), F.sum("_rows").over(w).alias("_all"))
    few = parts.limit(MOST_PARTS + 1).count() <= MOST_PARTS
    out = rows.join(F.broadcast(parts) if few else parts, (F.col("_part") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key")))
    out = out.withColumn(name, F.col("_id") - F.col("_first") + 1 + F.col("_before"))
    out = out.withColumn(count, F.col("_all")) if count else out
    return out.drop("_id", "_part", "_key", "_of", "_first", "_before", "_all")


def top_within(df: DataFrame, k: int, by: list[Column], within: list[str], name: str = "rank") -> DataFrame:
    """First ``k`` rows of each group; map tasks keep k a group before the shuffle (WindowGroupLimit)."""
    return ranked(df, by, within, name).filter(F.col(name) <= k)


def top(df: DataFrame, k: int, by: list[Column], name: str = "rank") -> DataFrame:
    """First ``k`` rows, numbered; each task sends k at most."""
    first = df.orderBy(*by).limit(k)
    return ranked(first, by, name=name)


def merged(shards: DataFrame, k: int, gid: str = "gid", score: str = "score", shard: str = "shard") -> DataFrame:
    """Merge ranked shards: an id's best row (score desc, shard asc), then the ``k`` best by (score desc, id asc)."""
    best = shards.groupBy(gid).agg(F.min(F.struct((-F.col(score)).alias("_s"), F.col(shard).alias("_h"))).alias("_b"))
    best = best.select(gid, (-F.col("_b._s")).alias(score), F.col("_b._h").alias(shard))
    return top(best, k, [F.desc(score), F.asc(gid)])


def out_of_order(ranked_rows: DataFrame, gid: str = "gid", score: str = "score", shard: str = "shard", rank: str = "rank") -> DataFrame:
    """Rows that come after a worse one in their shard, repeat an id, or hold a negative id or a score that isn't finite."""
    w = Window.partitionBy(shard).orderBy(rank)
    before = F.lag(F.struct((-F.col(score)).alias("s"), F.col(gid).alias("g"))).over(w)
    again = F.count("*").over(Window.partitionBy(shard, gid)) > 1
    bad = again | (F.col(gid) < 0) | F.isnan(F.col(score).cast("double")) | (F.abs(F.col(score).cast("double")) == float("inf"))
    return ranked_rows.withColumn("_bad", bad | F.coalesce(before > F.struct((-F.col(score)).alias("s"), F.col(gid).alias("g")), F.lit(False))).filter("_bad").drop("_bad")


def schedule(channels: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """Admit ids channel by channel (baseline, strict, balanced, loose), each up to its budget of new ids.

    ``channels``: (channel, gid, score, rank). A channel is read until its new ids reach the budget; ids that are known
    by then get its flag (1, 2, 4, 8), score and rank. Result: gid, source_flags, first_channel, first_rank, position.
    Only a channel's head is ordered as a whole: it holds its budget plus the ids admitted before it, as no more rows
    than that can be read before the budget is met.
    """
    if set(budgets) - set(CHANNELS) or "baseline" not in budgets:
        raise ValueError("budgets need baseline, and know strict, balanced and loose besides")
    known, read, most = None, [], 0
    for k, name in enumerate(CHANNELS):
        if not budgets.get(name):
            continue
        most += budgets[name]
        rows = channels.filter(F.col("channel") == name).orderBy("rank").limit(most).select("gid", "score", "rank")
        if known is None:
            rows = rows.withColumn("new", F.lit(1))
        else:
            rows = rows.join(known.withColumn("old", F.lit(1)), "gid", "left").select("gid", "score", "rank", F.when(F.col("old").isNull(), 1).otherwise(0).alias("new"))
        before = F.coalesce(F.sum("new").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = rows.withColumn("before", before).filter(F.col("before") < budgets[name])
        read.append(rows.select("gid", F.lit(k).alias("channel"), "score", "rank", "new"))
        ids = rows.select("gid")
        known = ids if known is None else known.union(ids).distinct()
    every = read[0]
    for r in read[1:]:
        every = every.unionByName(r)
    out = every.groupBy("gid").agg(
        F.sum(F.expr("shiftleft(1L, channel)")).alias("source_flags"),
        F.min(F.struct("channel", "rank")).alias("first"),
    )
    out = out.select("gid", "source_flags", F.col("first.channel").cast("bigint").alias("first_channel"), F.col("first.rank").cast("bigint").alias("first_rank"))
    return ranked(out, [F.asc("first_channel"), F.asc("first_rank")], name="position")


def collapse(rows: DataFrame, keys: list[str], score: str = "score", gid: str = "gid", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each group's best row by (score desc, id asc): a hash aggregate, no sort."""
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(gid)).alias("g"), *[F.col(c).alias(c) for c in keep])).alias("b")
    return rows.groupBy(*keys).agg(best).select(*keys, (-F.col("b.g")).alias(gid), F.col("b.s").alias(score), *[F.col(f"b.{c}").alias(c) for c in keep])


def union_of_tops(rows: DataFrame, objectives: list[str], n: int, gid: str = "gid", within: list[str] | None = None) -> DataFrame:
    """Union of the ``n`` best ids by each objective column, in each group if given; rank_<objective> is null where an id isn't among them."""
    parts, keys = None, [*(within or []), gid]
    for o in objectives:
        by, own = [F.desc("score"), F.asc(gid)], rows.select(*keys, F.col(o).alias("score"))
        part = (top_within(own, n, by, within) if within else top(own, n, by)).select(*keys, F.lit(o).alias("objective"), "rank")
        parts = part if parts is None else parts.unionByName(part)
    out = parts.groupBy(*keys).agg(*[F.max(F.when(F.col("objective") == o, F.col("rank"))).alias(f"rank_{o}") for o in objectives], F.min("rank").alias("best_rank"))
    return out


def capped(rows: DataFrame, molecule: str, cap: int, by: list[Column]) -> DataFrame:
    """The first row of each molecule in the given order, then the first ``cap`` of these."""
    return top(top_within(rows, 1, by, [molecule], "_one").drop("_one"), cap, by)


def retained(rows: DataFrame, n: int, gid: str = "gid", distance: str = "distance") -> DataFrame:
    """The ``n`` nearest rows with an id of 0 or more."""
    return top(rows.filter(F.col(gid) >= 0), n, [F.asc(distance), F.asc(gid)])


def correlation(a: str, b: str, least: float = 0.0) -> Column:
    """Pearson correlation as an aggregate; null if there are under two rows or a side's deviation is at most ``least``."""
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    both = F.when((sa > least) & (sb > least), sa * sb)
    return F.when(F.count("*") > 1, F.covar_pop(a, b) / F.nullif(both, F.lit(0.0)))


def average_ranks(rows: DataFrame, value: str, within: list[str], name: str = "average_rank") -> DataFrame:
    """0-based ranks, ties sharing their mean."""
    w = Window.partitionBy(*within)
    return rows.withColumn(name, F.rank().over(w.orderBy(value)) - 1 + (F.count("*").over(w.partitionBy(*within, value)) - 1) / 2)


def spearman(rows: DataFrame, a: str, b: str, within: list[str], name: str = "spearman") -> DataFrame:
    """Rank correlation of two columns by group; null if a side is constant."""
    r = average_ranks(average_ranks(rows, a, within, "_a"), b, within, "_b")
    out = r.groupBy(*within).agg(correlation("_a", "_b").alias(name), F.count("*").alias("n"))
    return out


def ranking_agreement(a: DataFrame, b: DataFrame, n: int, gid: str = "gid") -> DataFrame:
    """Of two rankings (id, rank) of the same ids: correlation of their ranks and ids in both tops."""
    both = a.select(gid, F.col("rank").alias("ra")).join(b.select(gid, F.col("rank").alias("rb")), gid)
    return both.agg(correlation("ra", "rb").alias("rank_correlation"), F.count_if((F.col("ra") <= n) & (F.col("rb") <= n)).alias("shared_top"), F.count("*").alias("n"))


def two_metric_comparison(rows: DataFrame, molecule: str, first: str, second: str, k: int, outside: int, gid: str = "gid") -> DataFrame:
    """Each molecule's best row by two metrics, with both ranks and the group: agreed, first_only, second_only or none."""
    one, two = (ranked_globally(collapse(rows.select(molecule, gid, F.col(m).alias("score")), [molecule]), [F.desc("score"), F.asc(molecule)]) for m in (first, second))
    both = one.select(molecule, F.col(gid).alias("first_gid"), F.col("rank").alias("first_rank")).join(two.select(molecule, F.col(gid).alias("second_gid"), F.col("rank").alias("second_rank")), molecule)
    a, b = F.col("first_rank"), F.col("second_rank")
    group = F.when((a <= k) & (b <= k), "agreed").when((a <= k) & (b > outside), "first_only").when((b <= k) & (a > outside), "second_only").otherwise("none")
    return both.withColumn("comparison", group)
