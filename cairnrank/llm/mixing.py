"""Mixing sources to target weights by fixed-length token blocks.

Each source's texts stand in a hashed order, and their words are one stream, cut into blocks of one length, ``block``
words or, so that none is left over, a little less (the first few of a source may have a word more than the rest). The mix
is a list of slots, dealt to output shards. How many slots of a shard go to each source is a multinomial draw by what each
source still owes, drawn anew for what a source can't give; so every shard is random and every source meets its target. A source's slots are numbered through; slot j takes block ``permutation(j mod blocks)`` of pass
``j div blocks``, a keyed Feistel permutation of the index, so each pass takes every block once at most. Slots and blocks
then join by index: no source's rows are gathered, sorted or sampled as a whole.

Targets: sources in order of code point, null last, have the weights 5, 2, 1, 5, ... and share all words; a target stops
at ``most`` times its source's size, and the excess is shared anew by weight until none is above. A block is taken
``most`` times at most, so no text's words are taken more often.

Defined cases: null and empty texts have no words and are taken 0 times; repeated rows are texts of their own; a null
source is a source; an empty table gives an empty table. Draws depend on ``seed`` and the rows alone. Per source and
shard the driver keeps one number (``CELLS`` at most, with fewer shards for more sources).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnrank.llm import text as T
from cairnrank.llm.skew import free_name
from cairnrank.session import ship, staged

WEIGHTS = (5, 2, 1)
#: Rows of a bucket of a source's order, on average; slots of a shard, at least; cells of the table of draws, at most;
#: buckets whose sums are run up in one task; sources, at most, as the driver sets their targets.
BUCKET, SHARD, CELLS, SHELF, MOST_SOURCES = 4_000, 4096, 200_000, 4096, 200_000
ROUNDS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)
_U = np.uint64


def targets(sizes: list[int], most: int = 3) -> list[float]:
    """Words due from each source, given their sizes in the sources' order."""
    weight = np.array([WEIGHTS[k % len(WEIGHTS)] for k in range(len(sizes))], float)
    size = np.array(sizes, float)
    due, free = np.zeros(len(size)), np.ones(len(size), bool)
    while free.any():
        left = size.sum() - due[~free].sum()
        due[free] = left * weight[free] / weight[free].sum()
        over = free & (due > most * size)
        if not over.any():
            break
        due[over] = most * size[over]
        free &= ~over
    return due.tolist()


def drawn_counts(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """``n`` slots among sources by what they owe, none over that."""
    out = np.zeros_like(left)
    while (missing := n - int(out.sum())) > 0:
        free = left - out
        out = np.minimum(out + rng.multinomial(missing, free / free.sum()), left)
    return out


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of range(size), by value: four Feistel rounds, walked until the value is in range."""
    half = np.maximum(1, -(-np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) // 2)).astype(np.uint64)
    mask = (_U(1) << half) - _U(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    key, top = key.astype(np.uint64), size.astype(np.uint64)
    while len(todo):
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for n in range(len(ROUNDS)):
            left, right = right, left ^ (T.mix(right + k + _U(ROUNDS[n])) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= top[todo]]
    return out.astype(np.int64)


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    T.forget()
    for batch in batches:
        size = [word for _, _, data, offsets in T.blocks(batch.column(3)) for word in T.word_count(data, offsets, ~T.SPACE).tolist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(size, pa.int64())], names=["doc_id", "mark", "source", "size"])


def _slots(seed: int) -> Callable:
    """Rows (shard, number, blocks, first, count) to a row for each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, number, blocks, first, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for low in range(first, first + count, 100_000):
                    j = np.arange(low, min(low + 100_000, first + count))
                    turn, size = j // blocks, np.full(len(j), blocks)
                    key = T.mix(turn.astype(np.uint64) * _U(0x2545F4914F6CDD1D) + _U((seed + number * 0xD1342543DE82EF95) % (1 << 64)))
                    cols = [np.full(len(j), shard), np.full(len(j), number), j, turn, permuted(j % blocks, size, key)]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["shard", "number", "slot", "turn", "block"])

    return run


def mix(docs: DataFrame, block: int = 64, most: int = 3, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The texts and the pieces of the mix.

    Texts: row (a key), doc_id, mark (hash of the text), source, size, source_size, target. Pieces: shard, slot, turn
    (how often its source was gone through before), row, first (word of the text), words.
    """
    spark = ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sized = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(source_col).cast("string").alias("source"), text.alias("text"))
    sized = sized.mapInArrow(_sized, "doc_id bigint, mark bigint, source string, size bigint").withColumn("row", F.monotonically_increasing_id())
    sized = staged(sized, "sized")
    total = sized.count()
    rows = sized.groupBy("source").agg(F.sum("size").alias("source_size")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources")
    rows = sorted(rows, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["source_size"] for r in rows]
    due = targets(sizes, most)
    blocks = [-(-n // block) for n in sizes]
    owed = np.array([min(round(t * b / n), most * b) if n else 0 for t, b, n in zip(due, blocks, sizes, strict=True)], np.int64)
    slots = int(owed.sum())
    shards = max(1, min(slots // SHARD, CELLS // max(1, len(rows))))
    rng, left, cells = np.random.default_rng(seed), owed.copy(), []
    for k in range(shards):
        drawn = drawn_counts(rng, left, int(left.sum()) // (shards - k))
        cells += [(k, n, int(blocks[n]), int(owed[n] - left[n]), int(drawn[n])) for n in np.flatnonzero(drawn).tolist()]
        left = left - drawn
    cells = spark.createDataFrame(cells, "shard bigint, number bigint, blocks bigint, first bigint, count bigint")
    cells = cells.repartition(max(1, min(shards, 4 * spark.sparkContext.defaultParallelism)), "shard")
    taken = cells.mapInArrow(_slots(seed), "shard bigint, number bigint, slot bigint, turn bigint, block bigint")
    lines = [(r["source"], n, s, t, s // max(1, b), s % max(1, b)) for n, (r, s, t, b) in enumerate(zip(rows, sizes, due, blocks, strict=True))]
    names = spark.createDataFrame(lines, "name string, number bigint, source_size bigint, target double, short bigint, longer bigint")
    texts = sized.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    # where each text starts in its source's stream: buckets by hash, then sums within and before them
    texts = texts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "mark", F.lit(seed)), F.lit(max(1, total // BUCKET))))
    within = Window.partitionBy("number", "bucket").orderBy("doc_id", "mark", "row").rowsBetween(Window.unboundedPreceding, -1)
    sums = texts.groupBy("number", "bucket").agg(F.sum("size").alias("words")).withColumn("shelf", F.floor(F.col("bucket") / SHELF))
    earlier = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    shelves = sums.groupBy("number", "shelf").agg(F.sum("words").alias("held"))
    shelves = shelves.select("number", "shelf", F.coalesce(F.sum("held").over(earlier(["number"], "shelf")), F.lit(0)).alias("under"))
    sums = sums.withColumn("base", F.coalesce(F.sum("words").over(earlier(["number", "shelf"], "bucket")), F.lit(0))).join(shelves, ["number", "shelf"])
    sums = sums.select("number", "bucket", (F.col("base") + F.col("under")).alias("base"))
    placed = texts.filter("size > 0").withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0))).join(sums, ["number", "bucket"])
    placed = placed.select("row", "number", "size", "short", "longer", (F.col("at") + F.col("base")).alias("at"))
    # blocks of short + 1 words, as many as ``longer``, come first
    which = "if({0} < longer * (short + 1), {0} div (short + 1), longer + ({0} - longer * (short + 1)) div short)".format
    parts = placed.withColumn("block", F.explode(F.sequence(F.expr(which("at")), F.expr(which("(at + size - 1)")))))
    begin = lambda k: k * F.col("short") + F.least(k, F.col("longer"))
    low = F.greatest(F.col("at"), begin(F.col("block")))
    high = F.least(F.col("at") + F.col("size"), begin(F.col("block") + 1))
    parts = parts.select("number", "block", "row", (low - F.col("at")).alias("first"), (high - low).alias("words"))
    # slots look small to the planner, as they come of few cells: they must not be broadcast
    pieces = taken.join(parts.hint("shuffle_merge"), ["number", "block"]).select("shard", "slot", "turn", "row", "first", "words")
    return texts.select("row", "doc_id", "mark", "source", "size", "source_size", "target"), pieces


def _pieced(at: int, chars: int | None) -> Callable:
    """Batches with a last column of (turn, first, words) to a row for each turn, its text cut to the words taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.forget()
        for batch in batches:
            data, offsets = T.buffers(batch.column(at))
            source, texts = [], []
            for k, taken in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                x = data[offsets[k] : offsets[k + 1]]
                starts, _, _ = T.word_spans(x, np.array([0, len(x)]), ~T.SPACE)
                edge = np.concatenate([starts, [len(x)]])
                edge[0] = 0
                turns: dict[tuple[int, int], list[tuple[int, int]]] = {}
                for p in taken:
                    turns.setdefault((p["row"], p["turn"]), []).append((p["first"], p["words"]))
                for _, spans in sorted(turns.items()):
                    source.append(k)
                    texts.append(b"".join(x[edge[a] : edge[a + n]].tobytes() for a, n in sorted(spans)))
            out = batch.take(pa.array(source, pa.int64()))
            cols = list(out.columns[:-1])
            cols[at] = pa.array(texts, pa.binary()).cast(pa.string())
            if chars is not None:
                cols[chars] = pa.array([len(t.decode()) for t in texts], pa.int64()).cast(cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:-1])

    return run


def mixed_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """The mix as rows like those of ``docs``: for each text and turn one, with the words that are taken in that turn."""
    texts, pieces = mix(docs, id_col=id_col, text_col=text_col, **how)
    lists = pieces.groupBy("row").agg(F.collect_list(F.struct("turn", "first", "words")).alias("taken"))
    lists = texts.select("row", "doc_id", "mark").join(lists.hint("shuffle_merge"), "row").select("doc_id", "mark", F.transform("taken", lambda t: F.struct(F.col("row").alias("row"), t["turn"].alias("turn"), t["first"].alias("first"), t["words"].alias("words"))).alias("taken"))
    # rows that repeat an id and its text stand once, with the pieces of all
    lists = lists.groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("taken")).alias("taken"), F.count("*").alias("rows"))
    names = {c: free_name(f"_{c}", docs.columns) for c in ("doc_id", "mark", "taken", "rows", "hash")}
    lists = staged(lists.withColumnsRenamed({c: names[c] for c in lists.columns}), "taken")
    own = docs.withColumn(names["hash"], F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    full = own.join(lists, F.col(id_col).cast("bigint").eqNullSafe(F.col(names["doc_id"])) & (F.col(names["hash"]) == F.col(names["mark"])))
    again = full.filter(F.col(names["rows"]) > 1).dropDuplicates([names["doc_id"], names["mark"]])
    full = full.filter(F.col(names["rows"]) == 1).unionByName(again).select(*docs.columns, names["taken"])
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    return full.mapInArrow(_pieced(docs.columns.index(text_col), chars), docs.schema)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    texts, pieces = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = pieces.groupBy("row").agg(F.sum("words").alias("taken"))
    out = texts.join(taken.hint("shuffle_merge"), "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
