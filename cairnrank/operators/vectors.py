"""Vector retrieval: standardisation, exact blocked top-k, bitset similarity, partitioned index, recall.

Queries are a stated set. They are worked in blocks of a checked size: each block is broadcast, every task keeps its own k
best rows per query over all its batches and sends them on once, and only these meet in one shuffle. So the corpus is scanned once a block,
never multiplied by the queries as rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnrank.operators.ranking import top_within
from cairnrank.session import ship

#: Queries of a block; rows that the driver samples for centroids.
BLOCK, TRAINING = 2048, 20_000
#: Rows that are compared at once.
GATHERED = 8192
_HITS = "query_id bigint, gid bigint, molecule bigint, value double"


def moments(corpus: DataFrame, vector: str = "embedding") -> DataFrame:
    """(dim, mean, std): population moments by dimension; a deviation under 1e-6 counts as 1."""
    each = corpus.select(F.posexplode(vector).alias("dim", "x"))
    std = F.stddev_pop("x")
    return each.groupBy("dim").agg(F.avg("x").alias("mean"), F.when(std < 1e-6, 1.0).otherwise(std).alias("std"))


def standardised(corpus: DataFrame, stats: list[tuple[float, float]], vector: str = "embedding") -> DataFrame:
    """Z-scores by (mean, std) of each dimension."""
    mean, std = (F.array(*[F.lit(float(s[k])) for s in stats]) for k in (0, 1))
    return corpus.withColumn(vector, F.zip_with(F.zip_with(F.col(vector), mean, lambda x, m: x - m), std, lambda x, s: x / s))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)


def squared_l2(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = x - q
    return np.einsum("ij,ij->i", d, d)


def bit_tanimoto(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """1 - |a and b| / |a or b| of rows of 64-bit words; two empty sets are 1 apart."""
    both, either = np.bitwise_count(x & q).sum(axis=1, dtype=np.int64), np.bitwise_count(x | q).sum(axis=1, dtype=np.int64)
    return 1 - both / np.maximum(either, 1)


class Best:
    """The k best (distance asc, id asc) rows of each query, kept over the batches of a task."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.rows = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))] * queries
        self.edge = np.full(queries, np.inf)

    def add(self, n: int, gid: np.ndarray, molecule: np.ndarray, value: np.ndarray) -> None:
        held = [np.concatenate(c) for c in zip(self.rows[n], (gid, molecule, value), strict=True)]
        at = np.lexsort((held[0], held[2]))[: self.k]
        self.rows[n] = tuple(c[at] for c in held)
        if len(at) == self.k:
            self.edge[n] = held[2][at[-1]]

    def batch(self, ids: np.ndarray) -> pa.RecordBatch:
        names = ["query_id", "gid", "molecule", "value"]
        size = [len(r[0]) for r in self.rows]
        cols = [np.concatenate(c) for c in zip(*self.rows, strict=True)] if self.rows else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(ids, np.int64), size)), *map(pa.array, cols)], names=names)


def gathered(batches: Iterator[pa.RecordBatch], rows: int = GATHERED) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` rows or a little more, as matrix products want them."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _nearest(shared, k: int, exclude: bool) -> Callable:
    """Each task's k best rows of each query, sent on once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, molecules, queries, distance, mean, std, words = shared.value
        best = Best(len(ids), k)
        product = distance is squared_l2
        square = (queries * queries).sum(axis=1) if product else None
        for batch in gathered(batches):
            batch = batch.filter(batch.column(2).is_valid())
            if not batch.num_rows:
                continue
            gid, molecule = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            if words:
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(len(gid), -1)
            else:
                x = (_matrix(batch.column(2), queries.shape[1]) - mean) / std
            own = (x * x).sum(axis=1) if product else None
            for low in range(0, len(ids), 256):
                part = slice(low, min(low + 256, len(ids)))
                if product:  # about right for all at once; those that may count are measured exactly
                    rough = own[:, None] + square[None, part] - 2 * x @ queries[part].T
                    slack = 1e-9 * (own[:, None] + square[None, part])
                for n in range(part.start, part.stop):
                    ok = molecule != molecules[n] if exclude else np.ones(len(gid), bool)
                    if product:
                        near, wide = rough[:, n - low], slack[:, n - low]
                        ok &= near - wide <= best.edge[n]
                        if ok.sum() > k:
                            ok &= near - wide <= np.partition((near + wide)[ok], k - 1)[k - 1]
                    at = np.flatnonzero(ok)
                    if not len(at):
                        continue
                    d = distance(x[at], queries[n])
                    good = np.isfinite(d) & (d <= best.edge[n])
                    at, d = at[good], d[good]
                    if len(at) > k:
                        keep = d <= np.partition(d, k - 1)[k - 1]
                        at, d = at[keep], d[keep]
                    if len(at):
                        best.add(n, gid[at], molecule[at], d)
        yield best.batch(ids)

    return run


def nearest(corpus: DataFrame, queries: DataFrame, k: int, distance: Callable = squared_l2, standard: bool = False, exclude: bool = False, block: int = BLOCK) -> DataFrame:
    """Exact k nearest rows of ``corpus`` for each query, both (gid, molecule, vector): query_id, gid, molecule, value, rank.

    ``standard``: on z-scores of the corpus. ``exclude``: rows of the query's own molecule are out. Ties by id; distances that
    aren't finite never count.
    """
    spark = ship(corpus.sparkSession)
    words = distance is bit_tanimoto
    kind = "array<bigint>" if words else "array<double>"
    rows = corpus.select(F.col("gid").cast("bigint"), F.col("molecule").cast("bigint"), F.col("vector").cast(kind))
    mean, std = np.zeros(1), np.ones(1)
    if standard:
        stats = sorted(moments(rows, "vector").collect())  # one row a dimension
        mean, std = np.array([r["mean"] for r in stats]), np.array([r["std"] for r in stats])
    out, held = None, []

    def worked() -> DataFrame:
        ids, molecules = (np.array([r[c] for r in held], np.int64) for c in (0, 1))
        q = np.array([r[2] for r in held])
        q = q.astype(np.int64).view(np.uint64).reshape(len(held), -1) if words else (q.astype(np.float64) - mean) / std
        shared = spark.sparkContext.broadcast((ids, molecules, q, distance, mean, std, words))
        return rows.mapInArrow(_nearest(shared, k, exclude), _HITS)

    for r in queries.select(F.col("gid").cast("bigint"), F.col("molecule").cast("bigint"), F.col("vector").cast(kind)).filter("vector is not null").toLocalIterator():
        held.append(r)
        if len(held) == block:
            out, held = (worked() if out is None else out.unionByName(worked())), []
    if held or out is None:
        part = worked() if held else spark.createDataFrame([], _HITS)
        out = part if out is None else out.unionByName(part)
    return top_within(out, k, [F.asc("value"), F.asc("gid")], ["query_id"])


def hierarchical(corpus2: DataFrame, corpus3: DataFrame, queries2: DataFrame, queries3: DataFrame, pool: int, limit: int, weight2: float = 0.4, weight3: float = 0.6) -> DataFrame:
    """A pool by bitset similarity, its molecules' best vector similarity, and their weighted mean.

    Molecules without a vector keep the first score alone. Vectors outside the pool don't count. Order: combined desc,
    first score desc, molecule. ``corpus2``: one row a molecule (gid = molecule); ``corpus3``: one or more.
    """
    two = nearest(corpus2, queries2, pool, bit_tanimoto).select("query_id", "molecule", (1 - F.col("value")).alias("score_2d"))
    near = nearest_of(corpus3, queries3, two)
    total = weight2 + weight3
    both = two.join(near, ["query_id", "molecule"], "left")
    score = F.when(F.col("score_3d").isNull(), F.col("score_2d")).otherwise((weight2 * F.col("score_2d") + weight3 * F.col("score_3d")) / total)
    return top_within(both.withColumn("combined", score), limit, [F.desc("combined"), F.desc("score_2d"), F.asc("molecule")], ["query_id"])


def nearest_of(corpus: DataFrame, queries: DataFrame, wanted: DataFrame) -> DataFrame:
    """Best similarity 1 / (1 + distance) of the wanted (query_id, molecule), and the row that has it."""
    q = queries.select(F.col("gid").alias("query_id"), F.col("vector").cast("array<double>").alias("q"))
    rows = corpus.select(F.col("gid").alias("conformer"), "molecule", F.col("vector").cast("array<double>").alias("x"))
    each = wanted.select("query_id", "molecule").join(rows, "molecule").join(q, "query_id")
    d = F.sqrt(F.aggregate(F.zip_with("x", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
    best = F.max(F.struct((1 / (1 + d)).alias("s"), (-F.col("conformer")).alias("c"))).alias("b")
    return each.groupBy("query_id", "molecule").agg(best).select("query_id", "molecule", F.col("b.s").alias("score_3d"), (-F.col("b.c")).alias("conformer"))


def recall(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """By query: share of the true k ids found, and the share that counts rows as near as the k-th true one."""
    edge = truth.filter(F.col("rank") <= k).groupBy("query_id").agg(F.max("value").alias("edge"), F.count("*").alias("n"))
    hit = truth.filter(F.col("rank") <= k).join(found.select("query_id", "gid"), ["query_id", "gid"]).groupBy("query_id").agg(F.count("*").alias("hits"))
    tied = found.join(edge, "query_id").filter(F.col("value") <= F.col("edge")).groupBy("query_id").agg(F.count("*").alias("tied"))
    out = edge.join(hit, "query_id", "left").join(tied, "query_id", "left")
    return out.select("query_id", (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("strict"), (F.least(F.coalesce("tied", F.lit(0)), F.col("n")) / F.col("n")).alias("with_ties"))


def centroids(corpus: DataFrame, lists: int, seed: int = 7, rounds: int = 15, training: int = TRAINING) -> np.ndarray:
    """Centroids of a bounded sample (the first ``training`` rows by hashed id), by k-means from spread starts."""
    rows = corpus.filter("vector is not null").orderBy(F.xxhash64("gid"), "gid").limit(training).select(F.col("vector").cast("array<double>"))
    x = np.array([r[0] for r in rows.collect()], np.float64)
    if not len(x):
        return np.zeros((0, 0))
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[: min(lists, len(x))]].copy()
    for _ in range(rounds):
        own = assign(x, c, 1)[:, 0]
        for k in range(len(c)):
            if (own == k).any():
                c[k] = x[own == k].mean(axis=0)
    return c


def assign(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each row."""
    d = (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None, :]
    return np.argsort(d, axis=1, kind="stable")[:, :n]


def _listed(shared, n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            at = assign(_matrix(batch.column(2), c.shape[1]), c, n)
            row = np.repeat(np.arange(batch.num_rows), at.shape[1])
            cols = batch.take(pa.array(row)).columns
            yield pa.RecordBatch.from_arrays([*cols, pa.array(at.ravel().astype(np.int32))], names=["gid", "molecule", "vector", "list"])

    return run


def sampled_ids(spark: SparkSession, total: int, count: int) -> DataFrame:
    """Ids spread evenly from 0 to ``total`` - 1, the ends included, each once, ``count`` of them at most."""
    if total < 1 or count < 1:
        raise ValueError("ids are spread over one row or more, and are one or more")
    count = min(total, count)
    step = F.lit((total - 1) / max(1, count - 1))
    at = F.when((F.col("id") == count - 1) & (F.lit(count) > 1), F.lit(total - 1)).otherwise(F.floor(F.col("id") * step))
    return spark.range(count).select(at.cast("bigint").alias("gid")).distinct()


def listed(rows: DataFrame, c: np.ndarray, n: int = 1) -> DataFrame:
    """Rows (gid, molecule, vector) with the number of their nearest list, or ``n`` rows for the n nearest lists."""
    spark = ship(rows.sparkSession)
    rows = rows.select(F.col("gid").cast("bigint"), F.col("molecule").cast("bigint"), F.col("vector").cast("array<double>")).filter("vector is not null")
    return rows.mapInArrow(_listed(spark.sparkContext.broadcast(c), n), "gid bigint, molecule bigint, vector array<double>, list int")


def _probed(batches: Iterator[pa.RecordBatch], shared, k: int) -> Iterator[pa.RecordBatch]:
    by_list, queries, ids = shared.value
    best = Best(len(ids), k)
    for batch in gathered(batches):
        gid, molecule, own = (batch.column(c).to_numpy() for c in (0, 1, 3))
        x = _matrix(batch.column(2), queries.shape[1])
        for number in np.unique(own).tolist():
            rows = np.flatnonzero(own == number)
            for n in by_list.get(number, ()):
                d = squared_l2(x[rows], queries[n])
                at = np.flatnonzero(d <= best.edge[n])
                best.add(n, gid[rows[at]], molecule[rows[at]], d[at])
    yield best.batch(ids)


def probe(index: DataFrame, queries: DataFrame, c: np.ndarray, probes: int, k: int, block: int = BLOCK) -> DataFrame:
    """k nearest rows among those of each query's ``probes`` nearest lists; every row of the index has its list.

    Where the index is written with ``partitionBy("list")``, the filter on lists prunes the files that are read.
    """
    spark = ship(index.sparkSession)
    out = None
    asked = queries.select("gid", F.col("vector").cast("array<double>")).filter("vector is not null").toLocalIterator()
    while part := [tuple(r) for r in islice(asked, block)]:
        q = np.array([r[1] for r in part], np.float64)
        by_list: dict[int, list[int]] = {}
        for n, lists in enumerate(assign(q, c, probes).tolist()):
            for number in lists:
                by_list.setdefault(number, []).append(n)
        shared = spark.sparkContext.broadcast((by_list, q, [r[0] for r in part]))
        hits = index.filter(F.col("list").isin(list(by_list))).select("gid", "molecule", "vector", "list").mapInArrow(lambda b, s=shared: _probed(b, s, k), _HITS)
        out = hits if out is None else out.unionByName(hits)
    out = spark.createDataFrame([], _HITS) if out is None else out
    return top_within(out, k, [F.asc("value"), F.asc("gid")], ["query_id"])
