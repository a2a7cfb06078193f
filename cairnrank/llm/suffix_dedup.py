"""Removal of long repeated byte strings by a run-length compressed Burrows-Wheeler index.

A byte goes if a string of ``length`` bytes covers it that also starts anywhere else, in the same text or another. No
match crosses texts. The work is exact and in these steps:

1. Parse: in every window of ``length`` bytes the least hash of its ``length // 3``-byte substrings is its anchor.
   Windows with the same anchor place form a phrase: the bytes that they span. Equal windows have equal anchors, so only
   phrases with equal anchors can share a window.
2. Copies of a phrase (by anchor and 64 bits of BLAKE2b) repeat as a whole: they are told by their number, and one of them
   goes on, unless it is its anchor's only phrase.
3. The distinct phrases, whole anchors together, are indexed by tasks of bounded size (``RunIndex``): runs of the
   Burrows-Wheeler transform and match lengths sampled at their ends. Streaming over the text, the matching statistic of
   a place is the last sample less the distance from it; windows of at least ``length`` are marked.
4. An anchor with more phrases than one task should hold has its windows counted by BLAKE2b instead, with map-side sums.

Defined cases: null and empty texts, and those shorter than ``length``, lose nothing; repeated rows are copies of each
other. An empty table gives an empty table. Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnrank.llm import text as T
from cairnrank.llm.near_dedup import MOST_IDS
from cairnrank.llm.skew import join_groups
from cairnrank.session import ship, staged

#: Window starts of a text that are parsed at once; bytes of phrases indexed at once; most phrases of an anchor there.
PIECE, INDEXED, MOST_PHRASES = 1 << 19, 1 << 20, 8192
_U = np.uint64
_PLACE = 20


def parse(data: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Phrases of a text: (anchor hash, phrase hash, first window start, last window start)."""
    core = max(1, length // 3)
    width = length - core + 1
    for begin in range(0, len(data) - length + 1, PIECE):
        end = min(begin + PIECE, len(data) - length + 1)
        seg = data[begin : end + length - 1]
        p = T.prefix(seg)
        at = np.arange(len(seg) - core + 1)
        h = T.mix((p[core:] - p[: len(at)]) * T.powers(len(p))[1][: len(at)])
        # the place in the low bits: ties go to the first, and minima are told apart by place
        tagged = (h & ~_U((1 << _PLACE) - 1)) | at.astype(np.uint64)
        rows = -(-len(tagged) // width)
        padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(tagged)] = tagged
        grid = padded.reshape(rows, width)
        head = np.minimum.accumulate(grid, axis=1).ravel()
        tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(tail[: end - begin], head[width - 1 : width - 1 + end - begin])
        new = np.flatnonzero(least[1:] != least[:-1]) + 1
        low, high = np.concatenate([[0], new]), np.concatenate([new, [len(least)]]) - 1
        anchor = h[(least[low] & _U((1 << _PLACE) - 1)).astype(np.int64)]
        raw = seg.tobytes()
        phrase = T.digests([raw[a:b] for a, b in zip(low.tolist(), (high + length).tolist(), strict=True)])[:, 0]
        yield anchor, phrase, low + begin, high + begin


def _parsed(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in T.blocks(batch.column(1)):
                out = []
                for k in range(j - i):
                    x = data[offsets[k] : offsets[k + 1]]
                    if len(x) >= length:
                        mark = _text_hash(x)
                        out += [(np.full(len(a), i + k), np.full(len(a), mark), a.view(np.int64), c.view(np.int64), lo, hi) for a, c, lo, hi in parse(x, length)]
                if out:
                    row, *rest = (np.concatenate(c) for c in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *map(pa.array, rest)], names=["doc_id", "mark", "anchor", "phrase", "low", "high"])

    return run


def _text_hash(x: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of ``s`` in order; 0 in it is a separator, each of its own, the first the least; ``s`` ends with one."""
    n, pack = len(s), 7
    wide = np.concatenate([s, np.zeros(pack, s.dtype)]).astype(np.int64)
    key, alive = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(pack):
        x = wide[k : k + n]
        key = (key << 9) | np.where(alive, x, 0)
        alive &= x != 0
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = (sorted_key[1:] != sorted_key[:-1]) | ~alive[order[1:]]
    slot = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, slot, 0))
    done = new & np.concatenate([new[1:], [True]])
    left, step = slot[~done], pack
    while len(left):
        p = order[left]
        both = rank[p] * n + rank[p + step]
        o = np.argsort(both, kind="stable")
        p, both = p[o], both[o]
        new = np.ones(len(p), bool)
        new[1:] = both[1:] != both[:-1]
        order[left] = p
        rank[p] = np.maximum.accumulate(np.where(new, left, 0))
        done = new & np.concatenate([new[1:], [True]])
        left, step = left[~done], step * 2
    return order


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of byte strings, with samples at the ends of its runs.

    ``s`` has bytes plus one, and a 0, a symbol of its own, behind each string. Kept are the symbol and length of each run, and for the
    first and the last suffix of each run its place in the text and the length of what it shares with the suffix beyond
    that end; suffixes inside a run follow from these. Shared lengths of ``exact`` or more are confirmed byte by byte.
    """

    def __init__(self, s: np.ndarray, exact: int):
        n = len(s)
        order = suffix_array(s)
        before = s[order - 1].astype(np.int64)
        before[(order == 0) | (before == 0)] = -1  # each its own symbol
        head = np.ones(n, bool)
        head[1:] = (before[1:] != before[:-1]) | (before[1:] < 0)
        first = np.flatnonzero(head)
        last = np.append(first[1:], n) - 1
        self.size, self.symbol, self.length = n, before[first], last - first + 1
        value = s.astype(np.uint64)
        value[s == 0] = _U(1000) + np.arange(int((s == 0).sum()), dtype=np.uint64)
        p = np.zeros(n + 1, np.uint64)
        up, down = T.powers(n + 1)
        np.cumsum(T.mix(value) * up[:n], out=p[1:])
        ends = np.flatnonzero(s == 0)
        longest = int(np.diff(ends, prepend=-1).max(initial=1))
        stop = ends[np.searchsorted(ends, np.arange(n))] if n else ends  # no match goes beyond the string's end
        raw = np.where(s > 0, s - 1, 0).astype(np.uint8)

        def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Lengths of common prefixes."""
            low, most = np.zeros(len(a), np.int64), np.minimum(stop[a] - a, stop[b] - b)
            step = 1 << (longest.bit_length() - 1)
            while step:
                ok = np.flatnonzero(low + step <= most)
                x, y, z = a[ok], b[ok], low[ok] + step
                same = (p[x + z] - p[x]) * down[x] == (p[y + z] - p[y]) * down[y]
                low[ok[same]] += step
                step >>= 1
            far = np.flatnonzero(low >= exact)
            for k in far[~T.same_spans(raw, a[far], b[far], low[far])].tolist():  # equal hashes of unlike bytes
                m = int(low[k])
                low[k] = int(np.argmax(raw[a[k] : a[k] + m] != raw[b[k] : b[k] + m]))
            return low

        #: (places in the text, in order; lengths shared there), for first and for last suffixes.
        self.samples = []
        for i, other in ((first, -1), (last, 1)):
            shared = np.zeros(len(i), np.int64)
            inner = (i + other >= 0) & (i + other < n)
            shared[inner] = common(order[i[inner]], order[i[inner] + other])
            place = order[i]
            sort = np.argsort(place)
            self.samples.append((place[sort], shared[sort]))

    def statistics(self) -> np.ndarray:
        """For each place, the longest string there that also starts elsewhere, streamed from sample to sample."""
        out = np.zeros(self.size, np.int64)
        for place, shared in self.samples:  # the text's first place is always one
            np.maximum(out, np.repeat(place + shared, np.diff(place, append=self.size)) - np.arange(self.size), out=out)
        return out


def repeated_starts(phrases: list[np.ndarray], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each byte string, first and last window starts of the runs of windows that also start elsewhere."""
    size = np.array([len(x) for x in phrases])
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    s = np.zeros(begin[-1], np.int16)
    for b, x in zip(begin, phrases, strict=False):
        s[b : b + len(x)] = x.astype(np.int16) + 1
    hit = np.concatenate([[False], RunIndex(s, length).statistics() >= length, [False]])
    edge = hit[1:] != hit[:-1]
    at = np.flatnonzero(edge)
    first, last = at[::2], at[1::2] - 1
    owner = np.searchsorted(begin, first, "right") - 1
    cut = np.searchsorted(owner, np.arange(len(phrases) + 1))
    return [(first[cut[k] : cut[k + 1]] - begin[k], last[cut[k] : cut[k + 1]] - begin[k]) for k in range(len(phrases))]


def _indexed(length: int) -> Callable:
    """Rows (anchor, copies, doc_id, mark, low, bytes), by anchor, to the spans that repeat of phrases with one copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def solved() -> pa.RecordBatch:
            found = repeated_starts([x[5] for x in held], length)
            rows = [(x[2], x[3], x[4] + a, x[4] + b + length) for x, (lo, hi) in zip(held, found, strict=True) if x[1] == 1 for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "mark", "x", "y"])

        for batch in batches:
            data, at = T.buffers(batch.column(5))
            cols = [batch.column(k).to_pylist() for k in range(5)]
            for k, row in enumerate(zip(*cols, strict=True)):
                if size >= INDEXED and held[-1][0] != row[0]:
                    yield solved()
                    held, size = [], 0
                x = data[at[k] : at[k + 1]]
                held.append((*row, x))
                size += len(x) + 1
        if held:
            yield solved()

    return run


def _cut(length: int) -> Callable:
    """Rows (doc_id, text, marks, spans) to the bytes of the phrases that the row's text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = T.buffers(batch.column(1))
            ids, lists = batch.column(0).to_pylist(), batch.column(2)
            out = []
            for k in range(batch.num_rows):
                x = data[at[k] : at[k + 1]]
                mark = _text_hash(x)
                for s in lists[k].as_py():
                    if s["mark"] == mark:
                        out.append((s["anchor"], s["copies"], ids[k], mark, s["low"], x[s["low"] : s["high"] + length].tobytes()))
                if len(out) > 4000 or k == batch.num_rows - 1:
                    cols = list(zip(*out, strict=True)) or [[]] * 6
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.binary())], names=["anchor", "copies", "doc_id", "mark", "low", "bytes"])
                    out = []

    return run


def _windows(length: int) -> Callable:
    """Rows (anchor, copies, doc_id, mark, low, bytes) to a hash for each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = T.buffers(batch.column(5))
            low = batch.column(4).to_numpy()
            for k in range(batch.num_rows):
                raw = data[at[k] : at[k + 1]].tobytes()
                i = np.arange(len(raw) - length + 1)
                h = T.digests([raw[x : x + length] for x in i.tolist()])[:, 0].view(np.int64)
                fixed = [batch.column(c).take(pa.array(np.full(len(i), k))) for c in range(4)]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(low[k] + i), pa.array(h)], names=["anchor", "copies", "doc_id", "mark", "at", "window"])

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, most_phrases: int = MOST_PHRASES) -> DataFrame:
    """(doc_id, mark, x, y): byte spans [x, y) that repeat, perhaps overlapping, of the texts with that id and hash."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    phrases = staged(texts.mapInArrow(_parsed(length), "doc_id bigint, mark bigint, anchor bigint, phrase bigint, low bigint, high bigint"), "phrases")
    total = phrases.count()
    anchors = phrases.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("phrase") == F.max("phrase")).alias("even")).filter("n > 1")
    again = staged(join_groups(phrases, staged(anchors, "anchors"), ["anchor"], "n", total), "again")
    whole = lambda df: df.select("doc_id", "mark", F.col("low").alias("x"), (F.col("high") + length).alias("y"))
    odd = again.filter("not even").drop("n", "even")
    distinct = odd.groupBy("anchor", "phrase").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "mark", "low", "high")).alias("one"))
    distinct = staged(distinct.select("anchor", "phrase", "copies", "one.*"), "distinct")
    copied = join_groups(odd, distinct.filter("copies > 1").select("anchor", "phrase", "copies"), ["anchor", "phrase"], "copies", total)
    # bytes of the distinct phrases, from one text that has each
    wanted = distinct.filter("doc_id is not null").groupBy("doc_id").agg(F.collect_list(F.struct("mark", "anchor", "copies", "low", "high")).alias("spans"))
    wanted = staged(wanted, "wanted")
    few = wanted.count() <= MOST_IDS
    have = texts.join(F.broadcast(wanted.select("doc_id")), "doc_id", "left_semi") if few else texts
    pieces = have.join(wanted.hint("shuffle_merge"), "doc_id").select("doc_id", "text", "spans")
    unnamed = distinct.filter("doc_id is null")
    if not unnamed.isEmpty():  # texts without an id are found by their hash alone
        lists = unnamed.groupBy("mark").agg(F.collect_list(F.struct("mark", "anchor", "copies", "low", "high")).alias("spans"))
        nulls = texts.filter("doc_id is null").mapInArrow(_marked, "doc_id bigint, text string, mark bigint").dropDuplicates(["mark"])
        pieces = pieces.unionByName(nulls.join(lists, "mark").select("doc_id", "text", "spans"))
    pieces = pieces.mapInArrow(_cut(length), "anchor bigint, copies bigint, doc_id bigint, mark bigint, low bigint, bytes binary")
    pieces = staged(pieces.dropDuplicates(["anchor", "doc_id", "mark", "low"]), "pieces")
    large = staged(distinct.groupBy("anchor").count().filter(F.col("count") > most_phrases).select("anchor"), "large")
    small = pieces.join(large, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor")
    parts = [whole(again.filter("even")), whole(copied), small.mapInArrow(_indexed(length), "doc_id bigint, mark bigint, x bigint, y bigint")]
    if not large.isEmpty():
        windows = pieces.join(large, "anchor", "left_semi").mapInArrow(_windows(length), "anchor bigint, copies bigint, doc_id bigint, mark bigint, at bigint, window bigint")
        windows = staged(windows, "windows")
        counts = staged(windows.groupBy("anchor", "window").agg(F.count("*").alias("n")).filter("n > 1"), "counts")
        hits = join_groups(windows, counts, ["anchor", "window"], "n", windows.count()).filter("copies = 1")
        parts.append(hits.select("doc_id", "mark", F.col("at").alias("x"), (F.col("at") + length).alias("y")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = T.buffers(batch.column(1))
        marks = [_text_hash(data[at[k] : at[k + 1]]) for k in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.int64())], names=["doc_id", "text", "mark"])


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted(spans):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = T.buffers(batch.column(1))
        lists = batch.column(2)
        rows = []
        for k in range(batch.num_rows):
            x = data[at[k] : at[k + 1]]
            spans = []
            if lists[k].is_valid:
                mark = _text_hash(x)
                spans = _merge([(s["x"], s["y"]) for s in lists[k].as_py() if s["mark"] == mark])
            keep, last = [], 0
            for a, b in spans:
                keep.append(x[last:a].tobytes())
                last = b
            keep.append(x[last:].tobytes())
            rows.append((len(x), b"".join(keep), [{"start": a, "stop": b} for a, b in spans]))
        n, kept, spans = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
            names=["doc_id", "n_bytes", "kept", "spans"],
        )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, most_phrases: int = MOST_PHRASES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, kept (the bytes that stay), spans (maximal removed runs)."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spans = repeated_spans(docs, id_col, text_col, length, most_phrases)
    lists = staged(spans.groupBy("doc_id").agg(F.collect_set(F.struct("mark", "x", "y")).alias("spans")), "spans")
    none = F.lit(None).cast("array<struct<mark:bigint,x:bigint,y:bigint>>").alias("spans")
    same = texts["doc_id"].eqNullSafe(lists["doc_id"])
    if lists.count() <= MOST_IDS:
        ids = F.broadcast(lists.select("doc_id"))
        same_id = texts["doc_id"].eqNullSafe(ids["doc_id"])
        hit = texts.join(ids, same_id, "left_semi")
        clear = texts.join(ids, same_id, "left_anti").select("doc_id", "text", none)
        full = hit.join(lists.hint("shuffle_merge"), hit["doc_id"].eqNullSafe(lists["doc_id"])).select(hit["doc_id"], "text", "spans").unionByName(clear)
    else:
        full = texts.join(lists, same, "left").select(texts["doc_id"], "text", "spans")
    return full.mapInArrow(_removed, "doc_id bigint, n_bytes bigint, kept binary, spans array<struct<start:bigint,stop:bigint>>")


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    done = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
