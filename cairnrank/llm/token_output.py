"""Token-ID output: Arrow files of equal-length sequences and masks, for zero-copy random access.

Texts are dealt by ranges of the id and sorted, so the ids of all texts, in ascending doc_id order, are those of file 0,
file 1, and so on. A file is an Arrow IPC file of batches with two fixed-size-list columns: ``ids`` (uint16, or uint32
for a vocabulary over 65,536) and ``mask`` (true where an id stands; the last sequence is padded). Beside it a second
Arrow file has the place of each text: doc_id, start and n_tokens within the file.

A text is encoded by its words, cut at white space and between letters and signs, as no token of this kind of tokenizer
crosses these places; each distinct word is encoded once and kept in a bounded table. The tokenizer must drop white space (``word_bpe_49k.json`` does).

Tasks write under names of their own attempt and report them, so lost executors and repeated tasks leave no half file
among those listed. Defined cases: null and empty texts are the end id alone; ids sort null first, and equal ids by text;
an empty table gives no file. Columns other than id and text are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnrank.llm import text as T
from cairnrank.session import scratch, ship, staged

#: Words kept; sequences of a batch; texts of a file, and most files, for which the driver keeps a line each.
MOST_KEPT, BATCH, FILE_TEXTS, MOST_FILES = 250_000, 64, 8192, 20_000
#: Where a word may be cut: between the letters a-z (1) and signs but the apostrophe (2). White space separates (0).
KINDS = np.full(256, 3, np.uint8)
KINDS[T.SPACE] = 0
KINDS[97:123] = 1
KINDS[[b for b in b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = 2
_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class Encoder:
    """Encodes texts through a table of words that have been encoded before."""

    def __init__(self, path: str, end_id: int, kept: int = MOST_KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.kept = Tokenizer.from_file(path), end_id, kept
        self.dtype = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self._clear()

    def _clear(self) -> None:
        self.table = T.WordTable(self._encoded, 2, np.int64, self.kept)
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0

    def _encoded(self, words: list[bytes]) -> np.ndarray:
        """Where the ids of each word are in ``flat``, and their number."""
        texts = [w.decode() for w in words]
        plain = [k for k, w in enumerate(texts) if w.isalpha()]
        got: list = [None] * len(words)
        if plain:  # words of letters are a piece each, so one call can encode them all
            e = self.tokenizer.encode(" ".join(texts[k] for k in plain), add_special_tokens=False)
            piece = np.array(e.word_ids, np.int64)
            cut = np.flatnonzero(np.diff(piece, prepend=-1))
            if len(cut) == len(plain):
                ids = np.array(e.ids, self.dtype)
                for k, part in zip(plain, np.split(ids, cut[1:]), strict=True):
                    got[k] = part
        rest = [k for k, x in enumerate(got) if x is None]
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
            got[k] = np.array(e.ids, self.dtype)
        size = np.fromiter(map(len, got), np.int64, len(got))
        total = self.used + int(size.sum())
        if total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(total, self.dtype)])
        self.flat[self.used : total] = np.concatenate(got)
        start = self.used + np.cumsum(size) - size
        self.used = total
        return np.stack([start, size], axis=1)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a block, each with the end id, and the number of each."""
        if self.used > 16 * self.kept:
            self._clear()
        if b"<|" in data.tobytes():  # a special token may stand there, as it is written
            starts, ends, at = T.word_spans(data, offsets, ~T.SPACE)
        else:
            data = T.LOWER[data]
            starts, ends, at = T.split_spans(data, offsets, KINDS)
        place = self.table.of(data, starts, ends)
        place = self.table.rows[place]
        # an end after the words of each text
        start, size = (np.insert(place[:, k], at[1:], x) for k, x in ((0, -1), (1, 1)))
        end = np.cumsum(size)
        source = np.repeat(start - end + size, size) + np.arange(end[-1] if len(end) else 0)
        last = at[1:] + np.arange(len(at) - 1)
        stop = end[last]
        ids = self.flat[source]
        ids[stop - 1] = self.end_id
        return ids, np.diff(stop, prepend=0)


def encoder(path: str, end_id: int, kept: int) -> Encoder:
    """The worker's encoder, kept from task to task."""
    return T.kept(("encoder", path, end_id, kept), lambda: Encoder(path, end_id, kept))


def _schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


def _written(folder: str, path: str, end_id: int, length: int, kept: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(path, end_id, kept), TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        schema, docs, total = _schema(enc.dtype, length), 0, 0
        sink = writer = index = None
        held = np.zeros(0, enc.dtype)

        def put(ids: np.ndarray, used: int) -> None:
            mask = np.zeros(len(ids), bool)
            mask[:used] = True
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), length) for x in (ids, mask)]
            writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=schema))

        for batch in batches:
            for i, j, data, offsets in T.blocks(batch.column(1)):
                if writer is None:
                    sink, side = (store.open_output_stream(f"{base}/{name}.{x}") for x in ("arrow", "index.arrow"))
                    writer, index = pa.ipc.new_file(sink, schema), pa.ipc.new_file(side, _INDEX)
                ids, count = enc.encode(data, offsets)
                start = total + np.cumsum(count) - count
                index.write_batch(pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(start), pa.array(count)], schema=_INDEX))
                docs, total = docs + j - i, total + len(ids)
                held = np.concatenate([held, ids])
                while len(held) >= BATCH * length:
                    put(held[: BATCH * length], BATCH * length)
                    held = held[BATCH * length :]
        if writer is not None:
            if len(held):
                put(np.concatenate([held, np.zeros(-len(held) % length, enc.dtype)]), len(held))
            for x in (writer, index, sink, side):
                x.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (task.partitionId(), f"{base}/{name}", docs, total)], names=["file", "path", "docs", "ids"])

    return run


def open_tokens(folder: str, path: str) -> tuple[pa.ipc.RecordBatchFileReader, pa.ipc.RecordBatchFileReader]:
    """A file's sequences and its index; mapped, not read, where the store is a local or shared disk."""
    store, _ = fs.FileSystem.from_uri(folder)
    local = isinstance(store, fs.LocalFileSystem)
    both = (pa.memory_map(f"{path}.{x}") if local else store.open_input_file(f"{path}.{x}") for x in ("arrow", "index.arrow"))
    a, b = both
    return pa.ipc.open_file(a), pa.ipc.open_file(b)


def sequence(reader: pa.ipc.RecordBatchFileReader, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-th sequence's ids, without a copy, and its mask."""
    batch = reader.get_batch(n // BATCH)
    length, k = batch.schema.field(0).type.list_size, n % BATCH
    ids = batch.column(0).values.to_numpy()[k * length : (k + 1) * length]
    return ids, batch.column(1).values[k * length : (k + 1) * length].to_numpy(zero_copy_only=False)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", kept: int = MOST_KEPT) -> tuple[str, list[dict]]:
    """Write the files; their folder, and for each file in order its path, texts, ids, and the ids before it.

    ``kept``: words of a worker's table; it changes no result.
    """
    spark = ship(docs.sparkSession)
    folder = folder or scratch(spark, "tokens")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = max(1, min(MOST_FILES, -(-docs.count() // FILE_TEXTS)))
    dealt = texts.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    done = staged(dealt.mapInArrow(_written(folder, tokenizer, end_id, length, kept), "file bigint, path string, docs bigint, ids bigint"), "files")
    files, before = [], 0
    for r in sorted(done.collect(), key=lambda r: r["file"]):  # one line a file: MOST_FILES, or the session's partitions
        files.append(r.asDict() | {"before": before})
        before += r["ids"]
    return folder, files


def _read(folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader, index = open_tokens(folder, path)
                k, held, base = 0, np.zeros(0, np.uint32), 0
                for n in range(index.num_record_batches):
                    part = index.get_batch(n)
                    start, count = part.column(1).to_numpy(), part.column(2).to_numpy()
                    stop = int(start[-1] + count[-1])
                    chunks = [held[int(start[0]) - base :]]
                    have = base + len(held)
                    while have < stop:
                        b = reader.get_batch(k)
                        mask = b.column(1).values.to_numpy(zero_copy_only=False)
                        chunks.append(b.column(0).values.to_numpy()[mask])
                        have, k = have + len(chunks[-1]), k + 1
                    held, base = np.concatenate(chunks), int(start[0])
                    wide = held.astype("<u4")
                    crc = [zlib.crc32(wide[a : a + c]) for a, c in zip((start - base).tolist(), count.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(start + before), part.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_tokens(spark: SparkSession, folder: str, files: list[dict]) -> DataFrame:
    """From the files: doc_id, start (ids of all texts before it), n_tokens, ids_crc32 (of its ids as uint32)."""
    lines = spark.createDataFrame([(f["path"], f["before"]) for f in files], "path string, before bigint")
    return lines.repartition(max(1, len(files))).mapInArrow(_read(folder), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op6_token_output(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_tokens(spark, *write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")))
