"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are runs of letters, digits and non-ASCII characters after A-Z became a-z. An item's windows are its runs of
``window`` words, or all its words if it has fewer. The automaton of all items is built once and broadcast; each text
streams through it, and the longest matching length at every word tells which windows end there. The automaton's size is
bounded: items beyond ``MOST_WORDS`` words go to further automata, each a pass of its own over the uncut text.

Defined cases: null and empty texts and items have no words; items with the same id count once, a null id as "null"; an
empty benchmark hits nothing; repeated rows are each marked. An empty table gives an empty table. Other columns pass
through unread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnrank.llm import text as T
from cairnrank.session import ship, staged

MOST_WORDS = 200_000
#: Word bytes in lower case, all others a space.
_WORDS = bytes(int(T.LOWER[b]) if T.ALNUM[b] else 32 for b in range(256))
_FOUND = "doc_id bigint, text string, n_words bigint, spans array<struct<start:bigint,stop:bigint>>, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Automaton:
    """Suffix automaton of several word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(i, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for i, words in items if words]
        self.least = min([window, *(len(w) for _, w in items)]) if items else 0
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        states = len(self.next)
        #: Of each state: the state of its suffix of ``window`` words, or -1; short items that are suffixes.
        self.of_window = [-1] * states
        self.short: dict[int, tuple[tuple[int, str], ...]] = {}
        own: dict[int, list[tuple[int, str]]] = {}
        self.items: dict[int, list[str]] = {}
        seen = [-1] * states
        for k, (name, words) in enumerate(items):
            v = 0
            for n, w in enumerate(words, 1):
                v = self.next[v][w]
                u = v
                while u > 0 and seen[u] != k:
                    seen[u] = k
                    if self.length[self.link[u]] < window <= self.length[u] and len(words) >= window:
                        self.items.setdefault(u, []).append(name)
                    u = self.link[u]
                if n == len(words) < window:
                    # the state of the whole item: v itself or, as v holds longer strings too, the same class
                    own.setdefault(v, []).append((n, name))
        for v in sorted(range(1, states), key=self.length.__getitem__):
            u = self.link[v]
            if self.length[v] >= window:
                self.of_window[v] = v if self.length[u] < window else self.of_window[u]
            if both := (*self.short.get(u, ()), *own.get(v, ())):
                self.short[v] = both

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length

        def split(p: int, q: int) -> int:
            clone = len(nxt)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            link[q] = clone
            while p >= 0 and nxt[p].get(w) == q:
                nxt[p][w] = clone
                p = link[p]
            return clone

        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else split(last, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else split(p, q)
        return new

    def stream(self, words: list[int], base: int, hit: np.ndarray, states: set[int], names: set[str]) -> None:
        """Mark in ``hit``, from ``base`` on, the words of windows; note the windows' states and the short items."""
        nxt, link, length, window, v, n = self.next, self.link, self.length, self.window, 0, 0
        for i, w in enumerate(words):
            while v and w not in nxt[v]:
                v = link[v]
                n = length[v]
            if w in nxt[v]:
                v = nxt[v][w]
                n += 1
            if n >= window:
                hit[base + i - n + 1 : base + i + 1] = True
                states.add(self.of_window[v])
            for k, name in self.short.get(v, ()):
                if k <= n:
                    hit[base + i - k + 1 : base + i + 1] = True
                    names.add(name)

    def match(self, words: list[bytes]) -> tuple[np.ndarray, set[str]] | None:
        """Hit words and items of a text; None if there are none."""
        if not self.least or len(words) < self.least:
            return None
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        known = np.concatenate([[False], ids >= 0, [False]])
        edge = np.flatnonzero(known[1:] != known[:-1])
        hit, states, names = None, set(), set()
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            if b - a >= self.least:
                hit = np.zeros(len(words), bool) if hit is None else hit
                self.stream(ids[a:b].tolist(), int(a), hit, states, names)
        if hit is None or not hit.any():
            return None
        for u in states:
            names.update(self.items.get(u, ()))
        return hit, names


def runs(hit: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _matched(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.forget()
        auto: Automaton = shared.value
        for batch in batches:
            n, spans, items = [], batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for k, x in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                words = words_of(x or b"")
                n.append(len(words))
                if found := auto.match(words):
                    hit, names = found
                    for s in spans[k]:
                        hit[s["start"] : s["stop"]] = True
                    spans[k], items[k] = runs(hit), sorted({*items[k], *names})
            kinds = [pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(spans, kinds[0]), pa.array(items, kinds[1])], names=["doc_id", "text", "n_words", "spans", "items"])

    return run


def automata(benchmark: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text", most_words: int = MOST_WORDS) -> Iterator[Automaton]:
    """Automata of at most ``most_words`` words each (one item more, if that is longer), made one after the other."""
    held: list[tuple[str, list[bytes]]] = []
    size = 0
    for r in benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        words = words_of((r["t"] or "").encode())
        if held and size + len(words) > most_words:
            yield Automaton(held, window)
            held, size = [], 0
        held.append((r["i"], words))
        size += len(words)
    yield Automaton(held, window)


def hit_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, text, n_words, spans (maximal runs of hit words), items (ids, as strings)."""
    spark = ship(docs.sparkSession)
    out = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    for k, auto in enumerate(automata(benchmark, window, most_words=most_words)):
        out = (staged(out, "spans") if k else out).mapInArrow(_matched(spark.sparkContext.broadcast(auto)), _FOUND)
    return out


def _marked(shared, at: int) -> Callable:
    """Batches whose last column, the hit spans of the texts (column ``at``), gets those of one automaton more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.forget()
        auto: Automaton = shared.value
        for batch in batches:
            spans = batch.column(batch.num_columns - 1).to_pylist()
            for k, x in enumerate(batch.column(at).cast(pa.binary()).to_pylist()):
                if found := auto.match(words_of(x or b"")):
                    for s in spans[k]:
                        found[0][s["start"] : s["stop"]] = True
                    spans[k] = runs(found[0])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, _SPANS)], names=batch.schema.names)

    return run


def _cleaned(shared, at: int, chars: int | None, longest: int, coverage: float, marked: bool) -> Callable:
    """Batches whose texts (column ``at``) are cut, without rows that are mostly benchmark.

    ``marked``: the last column, which goes, has the hit spans of the automata before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.forget()
        auto: Automaton = shared.value
        for batch in batches:
            before = batch.column(batch.num_columns - 1).to_pylist() if marked else repeat([])
            if marked:
                batch = batch.select(range(batch.num_columns - 1))
            texts, keep = batch.column(at).cast(pa.binary()).to_pylist(), []
            for k, (x, held) in enumerate(zip(texts, before, strict=marked)):
                words = words_of(x or b"")
                found = auto.match(words)
                mask = found[0] if found else np.zeros(len(words) if held else 0, bool)
                for s in held:
                    mask[s["start"] : s["stop"]] = True
                spans = [s for s in runs(mask) if s["stop"] - s["start"] > longest]
                hit = sum(s["stop"] - s["start"] for s in spans)
                keep.append(hit <= coverage * len(words))
                if spans:
                    data = np.frombuffer(x, np.uint8)
                    starts, ends, _ = T.word_spans(data, np.array([0, len(x)]), T.ALNUM)
                    left, last = [], 0
                    for s in spans:
                        left.append(x[last : starts[s["start"]]])
                        last = ends[s["stop"] - 1]
                    texts[k] = b"".join([*left, x[last:]])
            cols = list(batch.columns)
            cols[at] = pa.array(texts, pa.binary()).cast(batch.schema.field(at).type)
            if chars is not None and cols[at] != batch.column(at):
                cols[chars] = pc.utf8_length(cols[at]).cast(cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema).filter(pa.array(keep))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, longest: int = 0, coverage: float = 0.5, text_col: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """``docs`` without runs of over ``longest`` hit words, and without rows of which these are over ``coverage``.

    Hit words are those of all automata on the uncut text; texts are cut and rows judged once, by the last of them.
    A column ``n_chars`` follows the texts that are cut.
    """
    spark = ship(docs.sparkSession)
    schema, at = docs.schema, docs.columns.index(text_col)
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    name = "_spans"
    while name in map(str.lower, docs.columns):
        name += "_"
    shared, marked = None, False
    for auto in automata(benchmark, window, most_words=most_words):
        if shared is not None:
            out = docs if marked else docs.withColumn(name, F.array().cast("array<struct<start:bigint,stop:bigint>>"))
            docs, marked = staged(out.mapInArrow(_marked(shared, at), out.schema), "spans"), True
        shared = spark.sparkContext.broadcast(auto)
    return docs.mapInArrow(_cleaned(shared, at, chars, longest, coverage, marked), schema)


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    found = hit_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hits = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        "doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
bi AS (SELECT item_id, ws, least(10, len(ws)) AS k, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS w FROM bi),
ks AS (SELECT DISTINCT k FROM win),
di AS (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k),
occ AS (SELECT di.doc_id, di.i, di.k, win.item_id FROM di JOIN win ON win.k = di.k AND win.w = array_to_string(di.ws[di.i:di.i + di.k - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""
