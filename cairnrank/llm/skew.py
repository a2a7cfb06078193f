"""Joins and components that hold when one key has a third of all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnrank.session import staged

#: A key with this share of all rows is hot, or with ``MOST_ROWS``, unless more than ``MOST_HOT`` keys could be: the number of
#: hot keys, and so what is broadcast, is bounded, and so are the rows of a key that isn't hot.
HOT_SHARE, MOST_ROWS, MOST_HOT = 1000, 1_000_000, 2_000_000


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores as none of ``columns`` has it."""
    while name.lower() in map(str.lower, columns):
        name += "_"
    return name


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """Join each row to its group's one row in ``groups``, whose ``size`` column counts rows among ``total``.

    Groups of over total / HOT_SHARE rows, or of ``MOST_ROWS``, are broadcast; the rest meet by shuffle, where no key
    can then have more. Both inputs should be staged tables: they are read twice.
    """
    limit = max(2, min(total // HOT_SHARE + 1, max(MOST_ROWS, total // MOST_HOT)))
    hot = F.broadcast(groups.filter(F.col(size) >= limit).withColumn("_hot", F.lit(True)))
    dealt = rows.join(hot, on, "left")
    rest = dealt.filter("_hot is null").select(*rows.columns).join(groups.filter(F.col(size) < limit), on, how)
    found = dealt.filter("_hot").drop("_hot")
    return found.select(*rest.columns).unionByName(rest)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's edges as a forest of stars: (node, least node of its part)."""
    for batch in batches:
        a, b = (batch.column(k).to_numpy() for k in (0, 1))
        nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
        up = np.arange(len(nodes))
        x, y = flat[: len(a)], flat[len(a) :]
        while True:  # hook roots to lesser roots, then halve paths, until nothing moves
            u, v = up[x], up[y]
            differ = u != v
            if not differ.any():
                break
            high, low = np.maximum(u, v)[differ], np.minimum(u, v)[differ]
            np.minimum.at(up, high, low)
            while (up[up] != up).any():
                up = up[up]
        keep = up != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[up[keep]]), pa.array(nodes[keep])], names=["a", "b"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable by ``edges`` (a, b: bigint), for nodes that have edges.

    Partitions contract their own edges first; then alternating large-star and small-star steps run until the edges
    are stars. Each step is a shuffle of edges with map-side minima; no component is gathered anywhere.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b")
    edges = staged(edges.distinct().mapInArrow(_contract, "a bigint, b bigint"), "edges")

    def lifted(pairs: DataFrame, of: str, to: str) -> DataFrame:
        """Each (of, to) with the least node seen from ``of``, itself included."""
        least = pairs.groupBy(of).agg(F.least(F.min(to), F.col(of)).alias("m"))
        return pairs.join(least, of)

    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = lifted(both, "a", "b").filter("b > a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        low = lifted(large, "b", "a")
        small = low.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(low.select(F.col("m").alias("a"), "b"))
        small = staged(small.filter("a < b").distinct(), "edges")
        # stars: no node is both a centre and a leaf, and no leaf has two centres
        counts = small.agg(F.count("*").alias("n"), F.countDistinct("b").alias("leaves")).first()
        edges = small
        if counts["n"] == counts["leaves"] and small.join(small.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not converge in {rounds} rounds")
    centres = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(centres)
