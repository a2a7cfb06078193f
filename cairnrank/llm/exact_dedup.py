"""Exact deduplication by two-pass Bloom filtering.

Pass one counts text hashes in a Bloom filter whose counters stop at two; pass two sends on only rows all of whose
counters reached two. Those rows alone shuffle, by the full SHA-256; all others pass straight through. Texts are equal
when their UTF-8 bytes are after A-Z became a-z. Null counts as empty.

Defined cases: empty and null texts are equal to each other; a null doc_id never beats another id, and a group of null
ids alone keeps them; rows that repeat a doc_id and its text all carry the same answer. An empty table gives an empty
table. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnrank.llm.skew import join_groups
from cairnrank.session import scratch, ship, staged

#: Counters a row, probes a row, counters a segment.
PER_ROW, PROBES, SEGMENT = 16, 2, 1 << 20
_U = np.uint64
_SCHEMA = "doc_id bigint, sha binary, slice int"


def _digests(slices: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas = [hashlib.sha256(x.lower() if x else b"").digest() for x in batch.column(1).cast(pa.binary()).to_pylist()]
            part = np.array([int.from_bytes(x[16:20], "little") % slices for x in shas], np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shas, pa.binary()), pa.array(part)], names=["doc_id", "sha", "slice"])

    return run


def _probes(shas: pa.Array, size: int) -> np.ndarray:
    """Counter positions, by probe and row, from the digests' own bits."""
    words = np.frombuffer(b"".join(shas.to_pylist()), "<u8").reshape(-1, 4)
    return np.stack([words[:, k] % _U(size) for k in range(PROBES)]).astype(np.int64)


def _counted(size: int) -> Callable:
    """By segment: the positions a task saw, and those it saw twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = np.zeros(0, np.int64)
        twice = np.zeros(0, np.int64)
        for batch in batches:
            seen = _probes(batch.column(0), size)
            # a row whose probes meet counts that position once
            flat = np.sort(np.concatenate([seen[0], seen[1][seen[1] != seen[0]], once]))
            twice = np.union1d(twice, flat[1:][flat[1:] == flat[:-1]])
            once = np.unique(flat)
        for seg in np.unique(once // SEGMENT):
            pick = lambda x, low=seg * SEGMENT: (x[(x >= low) & (x < low + SEGMENT)] - low).astype(np.uint32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([int(seg)], pa.int64()), pa.array([pick(once)], pa.binary()), pa.array([pick(twice)], pa.binary())], names=["segment", "once", "twice"])

    return run


def _merged(table: pa.Table) -> pa.Table:
    """A segment's counters that reached two, as bits."""
    count = np.zeros(SEGMENT, np.uint8)
    for name in ("once", "twice"):
        for x in table.column(name).to_pylist():
            at = np.frombuffer(x, np.uint32)
            count[at] = np.minimum(count[at] + 1, 2)
    return pa.table({"segment": table.column("segment")[:1].combine_chunks(), "bits": pa.array([np.packbits(count >= 2).tobytes()], pa.binary())})


def _tested(size: int, bits) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            at = _probes(batch.column(1), size)
            hit = (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit.all(axis=0))], names=["doc_id", "sha", "maybe"])

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_mb: int = 32) -> DataFrame:
    """One row per row of ``docs``: doc_id, sha (of the normalised text), keep_id, group_size, kept.

    ``filter_mb`` bounds the filter that is broadcast: more rows than it holds are worked in slices of the hash space,
    each with a filter of its own over its own part of the digest table.
    """
    spark = ship(docs.sparkSession)
    total = docs.count()
    slices = max(1, -(-total * PER_ROW // (filter_mb << 23)))
    size = -(-max(1, -(-total // slices)) * PER_ROW // SEGMENT) * SEGMENT
    table = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = staged(table.mapInArrow(_digests(slices), _SCHEMA), "digests", ["slice"] if slices > 1 else None)
    result = None
    for k in range(slices):
        part = (table.filter(F.col("slice") == k) if slices > 1 else table).select("doc_id", "sha")
        counts = part.select("sha").mapInArrow(_counted(size), "segment bigint, once binary, twice binary")
        full = np.zeros(size // 8, np.uint8)
        for r in counts.groupBy("segment").applyInArrow(_merged, "segment bigint, bits binary").toLocalIterator():
            full[r["segment"] * SEGMENT // 8 :][: SEGMENT // 8] = np.frombuffer(r["bits"], np.uint8)
        tested = part.mapInArrow(_tested(size, spark.sparkContext.broadcast(full)), "doc_id bigint, sha binary, maybe boolean")
        alone = tested.filter("not maybe").select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"))
        again = staged(tested.filter("maybe").select("doc_id", "sha"), "repeats")
        groups = staged(again.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
        part = alone.unionByName(join_groups(again, groups, ["sha"], "group_size", total).select(*alone.columns))
        if slices == 1:
            result = part
        elif result is None:
            result, path = part, scratch(spark, "slices")
            part.write.parquet(path)
        else:  # so that the plan stays as it is, however many there are
            part.write.mode("append").parquet(path)
    if slices > 1:
        result = spark.read.schema(result.schema).parquet(path)
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    groups = exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


OP9_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
