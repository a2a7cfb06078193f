"""Near deduplication with SetSketch registers.

A document's set is its distinct word shingles. Each set gets ``bands * rows`` registers: truncated minima of
exponentially spaced points, on a logarithmic scale of base ``BASE``. Registers of a union are the maxima of registers,
and two registers are equal with a probability close to the Jaccard similarity, so bands of them are hashed to buckets.
Pairs that meet in a bucket are estimated by joint likelihood of the register order, and what may reach the threshold is
confirmed on the full sets, in which words stand by 64 bits of a cryptographic hash. With the defaults a pair at exactly
80 % is missed with a probability of 1.2e-7.

Work in a bucket is kept from growing with its square:

1. equal sets become one class, and only its representative goes on;
2. buckets with the same members become one; a pair counts only in its first common band;
3. a bucket is dealt into chunks; each chunk sends on a spanning forest of its likely pairs, which is confirmed, and
   confirmed links are joined into components;
4. only where a bucket still holds several components are its likely pairs across them confirmed, chunk by chunk: the
   documents in such pairs are fetched, and each chunk sends on links that join components and no others.

So no link between different components is lost, and none within one is needed. Defined cases: no words or null text:
the empty set, linked with nothing; fewer words than a shingle: all of them as one shingle; rows with the same doc_id
are one document: each row has its own set's size, and all have one component, which the sets of all of them join; a null
doc_id has the component of its equals (null if it has none). An empty table gives an empty
table. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnrank.llm import text as T
from cairnrank.llm.skew import components, join_groups
from cairnrank.session import ship, staged

BASE, RATE, TOP = 1.001, 20.0, 65534
#: Rows of a chunk; nats of likelihood by which a pair may miss the threshold; most ids that are broadcast.
CHUNK, SLACK, MOST_IDS = 256, 12.0, 2_000_000
#: Words whose hash a worker keeps; it changes no result.
KEPT = 100_000
_U = np.uint64
_SKETCHED = "doc_id bigint, n bigint, sig binary, regs binary"


def sets_of(data: np.ndarray, offsets: np.ndarray, size: int, strong: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and their row offsets. ``strong``: of words by ``text.digests``."""
    data = T.LOWER[data]
    starts, ends, at = T.word_spans(data, offsets, ~T.SPACE)
    if strong:
        table = T.kept("digests", lambda: T.WordTable(T.digests, 1, np.uint64, KEPT))
        rows = table.of(data, starts, ends)  # which may move the table's rows
        words = table.rows[rows, 0]
    else:
        words = T.word_hashes(data, starts, ends)
    out, n = [], np.zeros(len(offsets), np.int64)
    for i in range(len(offsets) - 1):
        h = np.sort(T.shingles(words[at[i] : at[i + 1]], size))
        if len(h) > 1:
            h = h[np.concatenate([[True], h[1:] != h[:-1]])]
        n[i + 1] = len(h)
        out.append(h)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(n)


def signatures(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128 bits for each set."""
    out = np.zeros((len(at) - 1, 2), np.uint64)
    full = at[1:] > at[:-1]
    for k, salt in enumerate((0x1234567, 0x89ABCDEF01)):
        if full.any():
            out[full, k] = np.add.reduceat(T.mix(flat ^ _U(salt)), at[:-1][full])
    return out


def setsketch(flat: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """Registers (sets x m) of SetSketch with independent registers.

    Each element is a Poisson process of rate m * RATE whose points fall on random registers; a register keeps its least
    point. A process stops when its point exceeds all minima of its set. Points are drawn in batches that double.
    """
    sets = len(at) - 1
    least = np.full(sets * m, np.inf)
    owner = np.repeat(np.arange(sets), np.diff(at))
    x, state, step, drawn = np.zeros(len(flat)), flat, 1, 0
    while len(owner):
        k = np.arange(drawn + 1, drawn + step + 1, dtype=np.uint64)
        random = T.mix(state[:, None] + k[None, :] * _U(0x9E3779B97F4A7C15))
        gap = -np.log(((random >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)
        gap[:, 0] += x
        points = np.cumsum(gap, axis=1)
        register = (((T.mix(random ^ _U(0x5851F42D4C957F2D)) >> _U(32)) * _U(m)) >> _U(32)).astype(np.int64)
        np.minimum.at(least, (owner[:, None] * m + register).ravel(), points.ravel())
        live = np.unique(owner)
        limit = np.zeros(sets)
        limit[live] = least.reshape(sets, m)[live].max(axis=1)
        x = points[:, -1]
        go = x < limit[owner]
        owner, x, state, drawn = owner[go], x[go], state[go], drawn + step
        step = min(2 * step, 64)
    with np.errstate(divide="ignore"):
        value = np.floor(1.0 - np.log(least / (RATE * m)) / np.log(BASE))
    return np.clip(value, 0, TOP).astype(np.uint16).reshape(sets, m)


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float, slack: float = SLACK) -> tuple[np.ndarray, np.ndarray]:
    """Whether each pair of register rows may have a Jaccard similarity of ``least``, and its most likely similarity."""
    m = a.shape[1]
    ok, best = np.zeros(len(a), bool), np.zeros(len(a))
    most = np.minimum(na, nb) / np.maximum(na, nb)
    same = (a == b).sum(axis=1)
    go = np.flatnonzero((most >= least - 1e-9) & (same >= m * least - 10.6 * np.sqrt(m * least * (1 - least))))
    if not len(go):
        return ok, best
    more, same = (a[go] > b[go]).sum(axis=1), same[go]
    less = m - more - same
    u = (na[go] / (na[go] + nb[go]))[:, None]
    v = 1 - u
    grid = np.concatenate([np.linspace(max(0.0, least - 0.5), least, 40, endpoint=False), np.linspace(least, 1.0, 21)])[None, :]
    j = np.minimum(grid, most[go][:, None])
    p = lambda y: np.maximum(-np.log1p(-np.maximum(y, 0) * (BASE - 1) / BASE) / np.log(BASE), 1e-12)
    up, down = p(u - v * j), p(v - u * j)
    score = more[:, None] * np.log(up) + less[:, None] * np.log(down) + same[:, None] * np.log(np.maximum(1 - up - down, 1e-12))
    ok[go] = score[:, 40:].max(axis=1) >= score.max(axis=1) - slack
    best[go] = np.take_along_axis(j, score.argmax(axis=1)[:, None], axis=1)[:, 0]
    return ok, best


def _sketched(size: int, m: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.forget()
        for batch in batches:
            for i, j, data, offsets in T.blocks(batch.column(1)):
                flat, at = sets_of(data, offsets, size)
                sig, regs = signatures(flat, at), setsketch(flat, at, m)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.array(np.diff(at)), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array([x.tobytes() for x in regs], pa.binary())],
                    names=["doc_id", "n", "sig", "regs"],
                )

    return run


def _sets(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in T.blocks(batch.column(1)):
                sig = [x.tobytes() for x in signatures(*sets_of(data, offsets, size))]
                flat, at = sets_of(data, offsets, size, strong=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.array(sig, pa.binary()), pa.array([flat[at[k] : at[k + 1]].tobytes() for k in range(j - i)], pa.binary())],
                    names=["rep", "sig", "items"],
                )

    return run


def _matrix(column: pa.Array, m: int) -> np.ndarray:
    data, at = T.buffers(column)
    return data[at[0] : at[-1]].view(np.uint16).reshape(-1, m)


def _banded(bands: int, rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regs = _matrix(batch.column(2), bands * rows).reshape(-1, bands, rows).astype(np.uint64)
            key = np.broadcast_to(np.arange(bands, dtype=np.uint64), regs.shape[:2])
            for k in range(rows):
                key = T.mix(key * _U(0xD1342543DE82EF95) + regs[:, :, k])
            n = len(regs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.ravel().view(np.int64)), pa.array(np.tile(np.arange(bands, dtype=np.int32), n)), *(pa.array(np.repeat(batch.column(c).to_numpy(), bands)) for c in (0, 1))],
                names=["key", "band", "rep", "cid"],
            )

    return run


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, from rows sorted by their first ``keys`` columns, with a group number by row."""
    held: list[pa.RecordBatch] = []

    def numbered(t: pa.Table) -> np.ndarray:
        new = np.zeros(len(t), bool)
        for c in range(keys):
            x = t.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.cumsum(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([*held, batch]).combine_chunks()
        group = numbered(t)
        cut = int(np.searchsorted(group, group[-1]))
        if cut:
            yield t.slice(0, cut), group[:cut]
        held = t.slice(cut).to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, numbered(t)


def _pairs(group: np.ndarray, most: int = 8_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of the same group, in slabs."""
    a, b, held = [], [], 0
    for d in range(1, len(group)):
        i = np.flatnonzero(group[d:] == group[:-d])
        if not len(i):
            break
        a.append(i)
        b.append(i + d)
        held += len(i)
        if held >= most:
            yield np.concatenate(a), np.concatenate(b)
            a, b, held = [], [], 0
    if a:
        yield np.concatenate(a), np.concatenate(b)


def _candidates(table: pa.Table, group: np.ndarray, m: int, rows: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Likely pairs of each group of rows (.., band, side, label, .., n, regs): two row numbers and a similarity.

    Pairs of the same label or of the same side (if the group has two), and pairs with an earlier common band, are none.
    """
    band, side, label, n = (table.column(c).to_numpy() for c in ("band", "side", "label", "n"))
    regs = _matrix(table.column("regs"), m)
    two = np.zeros(group[-1] + 1, bool)
    two[group[side > 0]] = True
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for i, j in _pairs(group):
        go = (label[i] != label[j]) & ((side[i] != side[j]) | ~two[group[i]])
        i, j = i[go], j[go]
        x, y = regs[i], regs[j]
        go = (x == y).reshape(len(i), m // rows, rows).all(axis=2).argmax(axis=1) == band[i]
        i, j = i[go], j[go]
        ok, best = likely(x[go], y[go], n[i], n[j], least)
        found.append((i[ok], j[ok], best[ok]))
    i, j, best = (np.concatenate(x) for x in zip(*found, strict=True))
    return i, j, best


class _Union:
    """Union-find over any values."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[x] = y
        return x != y


def _forest(m: int, rows: int, least: float) -> Callable:
    """Of the likely pairs of each group of rows (key, c, s, ...), a spanning forest by greatest likely similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _grouped(batches, 3):
            i, j, best = _candidates(table, group, m, rows, least)
            tree, keep = _Union(), []
            for k in np.argsort(-best, kind="stable").tolist():
                if tree.join(int(i[k]), int(j[k])):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([table.column(c).combine_chunks().take(pa.array(k[keep])) for k in (i, j) for c in ("rep", "cid")], names=["a", "ca", "b", "cb"])

    return run


def _involved(m: int, rows: int, least: float) -> Callable:
    """Of each group of rows (key, c, s, ...), those that are in a likely pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _grouped(batches, 3):
            i, j, _ = _candidates(table, group, m, rows, least)
            yield from table.take(pa.array(np.union1d(i, j))).to_batches()

    return run


def _settled(m: int, rows: int, least: float, percent: int) -> Callable:
    """Confirmed links between labels within each group of rows (key, c, s, .., items), as many as join what can be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _grouped(batches, 3):
            i, j, _ = _candidates(table, group, m, rows, least)
            label, rep = table.column("label").to_numpy(), table.column("rep").to_numpy()
            data, at = T.buffers(table.column("items"))
            sets = [data[at[k] : at[k + 1]].view(np.uint64) for k in range(len(table))]
            joined, out = _Union(), []
            order = np.lexsort((j, i))
            i, j = i[order], j[order]
            for first in np.flatnonzero(np.diff(i, prepend=-1)).tolist():
                x = int(i[first])
                own = sets[x]
                others = j[first : np.searchsorted(i, x, "right")]
                others = [y for y in others.tolist() if joined.find(int(label[y])) != joined.find(int(label[x]))]
                if not others:
                    continue
                size = np.array([len(sets[y]) for y in others])
                flat = np.concatenate([sets[y] for y in others])
                place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                common = np.add.reduceat((own[place] == flat).astype(np.int64), np.cumsum(size) - size)
                for k in np.flatnonzero(100 * common >= percent * (len(own) + size - common)).tolist():
                    if joined.join(int(label[x]), int(label[others[k]])):
                        out.append((x, others[k]))
            pick = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(rep[pick[:, 0]]), pa.array(rep[pick[:, 1]])], names=["a", "b"])

    return run


def _confirmed(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, at = T.buffers(batch.column(2))
            two, bt = T.buffers(batch.column(3))
            ok = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                x, y = one[at[k] : at[k + 1]].view(np.uint64), two[bt[k] : bt[k + 1]].view(np.uint64)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                ok[k] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], names=["a", "b"])

    return run


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = 40, rows: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept (is it its component's least doc_id?)."""
    ship(docs.sparkSession)
    m, least = bands * rows, percent / 100
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketched = staged(texts.mapInArrow(_sketched(shingle, m), _SKETCHED), "sketches")
    total = sketched.count()
    classes = sketched.filter("n > 0").groupBy("sig")
    classes = staged(classes.agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("regs").alias("regs")).filter("rep is not null"), "classes")
    classes = classes.withColumn("cid", F.xxhash64("sig"))  # tells apart the sets of rows that share an id
    # buckets with two members or more, those with the same members once, by their first band
    banded = staged(classes.select("rep", "cid", "regs").mapInArrow(_banded(bands, rows), "key bigint, band int, rep bigint, cid bigint"), "bands")
    buckets = banded.groupBy("key", "band").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("rep", "cid")).alias("x"), F.bit_xor(F.xxhash64("cid", "rep")).alias("y"))
    buckets = buckets.filter("k > 1").groupBy("k", "x", "y").agg(F.min(F.struct("band", "key")).alias("first"))
    buckets = staged(buckets.select(F.col("first.key").alias("key"), F.col("first.band").alias("band"), "k", F.ceil(F.col("k") / CHUNK).cast("int").alias("chunks")), "buckets")
    if buckets.count() <= MOST_IDS:  # spares most rows the shuffle
        banded = banded.join(F.broadcast(buckets.select("key")), "key", "left_semi")
    members = join_groups(banded, buckets, ["key", "band"], "k", total * bands)
    members = members.join(classes.select("rep", "cid", "n", "regs"), ["rep", "cid"])
    members = members.withColumn("c", F.pmod(F.xxhash64("rep", "cid", "key"), F.col("chunks")).cast("int"))
    members = staged(members, "members")

    def dealt(rows_: DataFrame, *more: str) -> DataFrame:
        rows_ = rows_.select("key", "c", "s", "band", "side", "label", "rep", "cid", "n", "regs", *more)
        return rows_.repartition("key", "c", "s").sortWithinPartitions("key", "c", "s")

    def sets(need: DataFrame) -> DataFrame:
        """Full sets of the documents with the ids in ``need``."""
        need = staged(need.distinct(), "need")
        there = texts.withColumnRenamed("doc_id", "rep").join(F.broadcast(need) if need.count() <= MOST_IDS else need, "rep", "left_semi")
        found = there.mapInArrow(_sets(shingle), "rep bigint, sig binary, items binary").select("rep", F.xxhash64("sig").alias("cid"), "items")
        return staged(found.dropDuplicates(["rep", "cid"]), "items")

    first = members.withColumns({"s": F.lit(0), "side": F.lit(0), "label": F.xxhash64("rep", "cid")})
    first = staged(dealt(first).mapInArrow(_forest(m, rows, least), "a bigint, ca bigint, b bigint, cb bigint").distinct(), "pairs")
    items = sets(first.select(F.col("a").alias("rep")).union(first.select("b")))
    side = lambda x, y: items.select(F.col("rep").alias(x), F.col("cid").alias(f"c{x}"), F.col("items").alias(y))
    full = first.join(side("a", "one"), ["a", "ca"]).join(side("b", "two"), ["b", "cb"])
    links = full.select("a", "b", "one", "two").mapInArrow(_confirmed(percent), "a bigint, b bigint")
    # ids of several sets, which are one document
    several = sketched.filter("doc_id is not null").groupBy("doc_id").agg((F.min("sig") < F.max("sig")).alias("several"))
    several = staged(several.filter("several").select("doc_id"), "several")
    if not (unique := several.isEmpty()):
        own = sketched.filter("n > 0").select("doc_id", "sig").join(several, "doc_id", "left_semi").distinct()
        links = links.unionByName(own.join(classes.select("sig", "rep"), "sig").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    links = staged(links, "links")
    label = components(links)
    # what is left: pairs across components, in buckets that hold several
    named = members.join(label.select(F.col("node").alias("rep"), F.col("component").alias("label")), "rep", "left")
    named = named.withColumn("label", F.coalesce("label", "rep")).filter("k > 2")
    parts = named.groupBy("key", "band", "label").count()
    parts = parts.groupBy("key", "band").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("parts"), (F.sum("count") - F.max("count")).alias("others"))
    mixed = named.join(parts.filter("parts > 1"), ["key", "band"])
    stray = F.ceil(F.col("others") / CHUNK).cast("int")
    small = mixed.filter("chunks = 1").withColumns({"s": F.lit(0), "side": F.lit(0)})
    large = mixed.filter("chunks > 1")
    homes = large.withColumns({"s": F.explode(F.sequence(F.lit(0), stray - 1)), "side": F.lit(0)})
    strays = large.filter("label != main").withColumn("s", F.pmod(F.xxhash64("cid", "rep", "key"), stray).cast("int"))
    strays = strays.withColumns({"c": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)), "side": F.lit(1)})
    rest = dealt(small.unionByName(homes).unionByName(strays))
    rest = staged(rest.mapInArrow(_involved(m, rows, least), rest.schema), "involved")
    rest = dealt(rest.join(sets(rest.select("rep")), ["rep", "cid"]), "items")
    rest = staged(rest.mapInArrow(_settled(m, rows, least, percent), "a bigint, b bigint"), "rest")
    if not rest.isEmpty():
        label = components(links.unionByName(rest))
    named = classes.select("sig", "rep", "size").join(label.withColumnRenamed("node", "rep"), "rep", "left").filter("size > 1 or component is not null")
    named = staged(named.select("sig", "size", F.coalesce("component", "rep").alias("component_id")), "named")
    out = join_groups(sketched.select("doc_id", "n", "sig"), named, ["sig"], "size", total, "left")
    if not unique:  # rows without words too
        ids = several.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("of_id"))
        out = out.join(ids, "doc_id", "left").withColumn("component_id", F.coalesce("of_id", "component_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` but for the ids in ``dropped`` (staged): a broadcast anti join if their number is small enough."""
    return docs.join(F.broadcast(dropped) if dropped.count() <= MOST_IDS else dropped, id_col, "left_anti")


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2)


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e2 AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS d, doc_id AS q FROM documents UNION SELECT r.d, e2.y FROM r JOIN e2 ON r.q = e2.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT d, min(q) AS component_id FROM r GROUP BY d) m ON m.d = d.doc_id
"""
