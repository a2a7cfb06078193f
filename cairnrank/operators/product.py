"""A partitioned index of product-quantised vectors: trained once on a bounded sample, appended to, and searched.

A vector's list is its nearest centroid; what is left of it is cut into ``m`` parts, each coded by its nearest code word.
The index is a Parquet table partitioned by list, so a probe reads its lists alone. Found rows are measured again by their
full vectors. Every row of an appended table is indexed; ids that the index has are left alone, so an append can be repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnrank.operators.ranking import top_within
from cairnrank.operators.vectors import BLOCK, TRAINING, Best, _matrix, assign, gathered, squared_l2
from cairnrank.session import ship

_CODED = "gid bigint, molecule bigint, codes binary, list int"


@dataclass
class Product:
    """Moments of the training sample, centroids of the lists, and code words (m, words, part) of what is left."""

    mean: np.ndarray
    std: np.ndarray
    centroids: np.ndarray
    words: np.ndarray

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.std

    def parts(self, x: np.ndarray) -> np.ndarray:
        """(rows, m, part) of a matrix, with zeros behind its last dimension."""
        m, _, size = self.words.shape
        return np.pad(x, ((0, 0), (0, m * size - x.shape[1]))).reshape(len(x), m, size)

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and codes (rows, m) of scaled rows."""
        own = assign(x, self.centroids, 1)[:, 0]
        left = self.parts(x - self.centroids[own])
        return own, np.stack([assign(left[:, k], self.words[k], 1)[:, 0] for k in range(len(self.words))], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray, number: int) -> np.ndarray:
        """(m, words): squared distance of each part of what is left of a query in a list to each code word."""
        left = self.parts((q - self.centroids[number])[None])[0]
        return ((self.words - left[:, None, :]) ** 2).sum(axis=2)


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int) -> np.ndarray:
    c = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        own = assign(x, c, 1)[:, 0]
        count = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return c


def train(corpus: DataFrame, lists: int = 512, m: int = 20, bits: int = 8, seed: int = 7, rounds: int = 12, training: int = TRAINING) -> Product:
    """A model of the first ``training`` rows by hashed id; a deviation under 1e-6 counts as 1."""
    if not 1 <= bits <= 8 or m < 1 or lists < 1:
        raise ValueError("lists and parts must be positive, and a code has 1 to 8 bits")
    rows = corpus.filter("vector is not null").orderBy(F.xxhash64("gid"), "gid").limit(training).select(F.col("vector").cast("array<double>"))
    x = np.array([r[0] for r in rows.collect()], np.float64)
    if not len(x):
        raise ValueError("no vectors to learn from")
    rng, std = np.random.default_rng(seed), x.std(axis=0)
    model = Product(x.mean(axis=0), np.where(std < 1e-6, 1.0, std), np.zeros((0, 0)), np.zeros((m, 0, -(-x.shape[1] // m))))
    z = model.scaled(x)
    model.centroids = _means(z, lists, rng, rounds)
    left = model.parts(z - model.centroids[assign(z, model.centroids, 1)[:, 0]])
    model.words = np.stack([_means(left[:, k], 1 << bits, rng, rounds) for k in range(m)])
    return model


def _coded(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Product = shared.value
        for batch in batches:
            own, codes = model.codes(model.scaled(_matrix(batch.column(2), len(model.mean))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(own.astype(np.int32))], names=["gid", "molecule", "codes", "list"])

    return run


def coded(rows: DataFrame, model: Product) -> DataFrame:
    """(gid, molecule, codes, list) of rows (gid, molecule, vector); rows without a vector are none."""
    spark = ship(rows.sparkSession)
    rows = rows.select(F.col("gid").cast("bigint"), F.col("molecule").cast("bigint"), F.col("vector").cast("array<double>")).filter("vector is not null")
    return rows.mapInArrow(_coded(spark.sparkContext.broadcast(model)), _CODED)


def opened(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_CODED).parquet(folder)


def append(rows: DataFrame, model: Product, folder: str) -> DataFrame:
    """Add rows to the index in ``folder``, which is made if need be; the index as it is then."""
    spark = rows.sparkSession
    new = coded(rows, model)
    try:
        new = new.join(opened(spark, folder).select("gid"), "gid", "left_anti").select("gid", "molecule", "codes", "list")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.dropDuplicates(["gid"]).write.mode("append").partitionBy("list").parquet(folder)
    return opened(spark, folder)


def _searched(shared, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, by_list, queries, ids = shared.value
        best, m = Best(len(ids), k), len(model.words)
        for batch in gathered(batches):
            gid, molecule, own = (batch.column(c).to_numpy() for c in (0, 1, 3))
            codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, m)
            for number in np.unique(own).tolist():
                at = np.flatnonzero(own == number)
                for n in by_list.get(number, ()):
                    table = model.tables(queries[n], number)
                    d = table[np.arange(m), codes[at]].sum(axis=1)
                    near = d <= best.edge[n]
                    best.add(n, gid[at[near]], molecule[at[near]], d[near])
        yield best.batch(ids)

    return run


def search(index: DataFrame, queries: DataFrame, model: Product, probes: int, k: int, corpus: DataFrame | None = None, pool: int | None = None, block: int = BLOCK) -> DataFrame:
    """query_id, gid, molecule, value, rank: the k nearest in each query's ``probes`` lists by coded distance.

    With ``corpus``: the ``pool`` nearest by code are measured by their vectors, on the model's scale, and the k nearest
    of them stay.
    """
    spark = ship(index.sparkSession)
    asked = queries.select(F.col("gid").cast("bigint"), F.col("vector").cast("array<double>")).filter("vector is not null").toLocalIterator()
    out, size = None, k if corpus is None else pool or 10 * k
    schema = "query_id bigint, gid bigint, molecule bigint, value double"
    while part := [tuple(r) for r in islice(asked, block)]:
        q = model.scaled(np.array([r[1] for r in part], np.float64))
        by_list: dict[int, list[int]] = {}
        for n, lists in enumerate(assign(q, model.centroids, probes).tolist()):
            for number in lists:
                by_list.setdefault(number, []).append(n)
        shared = spark.sparkContext.broadcast((model, by_list, q, [r[0] for r in part]))
        hits = index.filter(F.col("list").isin(list(by_list))).select("gid", "molecule", "codes", "list").mapInArrow(_searched(shared, size), schema)
        out = hits if out is None else out.unionByName(hits)
    out = spark.createDataFrame([], schema) if out is None else out
    by = [F.asc("value"), F.asc("gid")]
    if corpus is None:
        return top_within(out, k, by, ["query_id"])
    near = top_within(out, size, by, ["query_id"]).select("query_id", "gid", "molecule")
    vectors = corpus.select(F.col("gid").cast("bigint"), F.col("vector").cast("array<double>").alias("x"))
    both = near.join(vectors, "gid").join(queries.select(F.col("gid").cast("bigint").alias("query_id"), F.col("vector").cast("array<double>").alias("q")), "query_id")
    return top_within(_measured(both, model), k, by, ["query_id"])


def _measured(both: DataFrame, model: Product) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(model.mean)
        for batch in batches:
            x, q = (model.scaled(_matrix(batch.column(c), width)) for c in (3, 4))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(squared_l2(x, q))], names=["query_id", "gid", "molecule", "value"])

    return both.select("query_id", "gid", "molecule", "x", "q").mapInArrow(run, "query_id bigint, gid bigint, molecule bigint, value double")
