"""Quality by a byte-level convolutional network in numpy.

A text is cut into chunks of ``CHUNK`` bytes, each overlapping the next, that cover it whole. Learned filters of ``WIDTH``
bytes run over a chunk at every second byte; each filter's greatest response in the chunk is kept (max-pooling), a dense
layer turns these into the chunk's logit, and the mean, greatest and least logits of the text's chunks are combined into
one probability. Filters are learnt on byte embeddings by Adam on a bounded sample of labelled texts; for scoring, filter
and embedding fold into one table of responses by byte and place, so a response is a sum of table rows.

Defined cases: null and empty texts are one chunk of padding and get its probability; repeated rows are each scored. An
empty table gives an empty table; without labels, or with one value only, every text gets that value's share. Labels,
language, source and id are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnrank.llm import text as T
from cairnrank.llm.training import held_out, sample
from cairnrank.session import ship

#: Bytes of a chunk and from one to the next; of a filter; bytes from one response to the next.
CHUNK, HOP, WIDTH, STRIDE = 512, 448, 8, 2
FILTERS, EMBED = 32, 8
#: Labelled texts of a value, at most; chunks of a text, and steps, to learn from.
SAMPLE, CHUNKS, STEPS, BATCH = 1200, 12, 700, 96
PAD = 256
#: Chunks that are made at once.
SLAB = 512


def chunks(data: np.ndarray) -> np.ndarray:
    """Chunks of a text, as rows of bytes; what is missing in the last is padding."""
    n = 1 + max(0, -(-(len(data) - CHUNK) // HOP))
    padded = np.full((n - 1) * HOP + CHUNK, PAD, np.int16)
    padded[: len(data)] = data
    return padded[np.arange(n)[:, None] * HOP + np.arange(CHUNK)[None, :]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _adam(grad: list[np.ndarray], state: list, params: list[np.ndarray], step: int, rate: float) -> None:
    for k, g in enumerate(grad):
        m, v = state[k]
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        params[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)


class Network:
    def __init__(self, rows: list[tuple], share: float = 0.5, seed: int = 10):
        """Learn from rows (doc_id, text, label); ``share`` of label 1 among all that is labelled."""
        self.share = share
        self.table = None
        if len({r[2] for r in rows}) < 2:
            return
        rng = np.random.default_rng(seed)
        every = [chunks(np.frombuffer((r[1] or "").encode(), np.uint8)) for r in rows]
        label = np.array([r[2] for r in rows], np.float64)
        weigh = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean()))
        some = [c[rng.permutation(len(c))[:CHUNKS]] for c in every]
        for k, c in enumerate(every):  # and a short cut of each, as texts can be short
            cut = np.full((1, CHUNK), PAD, np.int16)
            size, low = int(rng.integers(12, 200)), int(rng.integers(0, CHUNK // 2))
            part = c[rng.integers(len(c))][low : low + size]
            cut[0, : len(part)] = part
            some[k] = np.concatenate([some[k], cut])
        owner = np.repeat(np.arange(len(some)), [len(c) for c in some])
        flat = np.concatenate(some)
        odds = (weigh / np.bincount(owner, minlength=len(some)))[owner]
        odds /= odds.sum()
        embed = rng.normal(0, 0.5, (257, EMBED))
        filters = rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS))
        params = [embed, filters, np.zeros(FILTERS), rng.normal(0, 0.1, FILTERS), np.zeros(1)]
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        places = (np.arange(0, CHUNK - WIDTH + 1, STRIDE)[:, None] + np.arange(WIDTH)[None, :]).ravel()
        n = len(places) // WIDTH
        for step in range(1, STEPS + 1):
            pick = rng.choice(len(flat), BATCH, p=odds)
            x, y = flat[pick], label[owner[pick]]
            view = params[0][x].astype(np.float32)[:, places].reshape(BATCH, n, WIDTH * EMBED)
            response = view @ params[1].astype(np.float32)
            top = response.argmax(axis=1)
            pooled = np.take_along_axis(response, top[:, None, :], axis=1)[:, 0].astype(np.float64) + params[2]
            active = np.where(pooled > 0, 1.0, 0.05)
            out = pooled * active
            delta = (_sigmoid(out @ params[3] + params[4]) - y) / BATCH
            back = delta[:, None] * params[3][None, :] * active
            at = view[np.arange(BATCH)[:, None], top].astype(np.float64)
            g_filters = np.einsum("bf,bfk->kf", back, at)
            g_embed = np.zeros_like(params[0])
            spread = back[:, :, None] * params[1].T[None]
            byte = x[np.arange(BATCH)[:, None, None], (top * STRIDE)[:, :, None] + np.arange(WIDTH)]
            np.add.at(g_embed, byte.ravel(), spread.reshape(-1, EMBED))
            grad = [g_embed, g_filters + 1e-5 * params[1], back.sum(axis=0), out.T @ delta + 1e-4 * params[3], np.array([delta.sum()])]
            _adam(grad, state, params, step, 0.01 if step < STEPS * 0.7 else 0.002)
        embed, filters, self.shift, self.dense, self.bias = params
        #: responses by place in the filter and byte
        self.table = np.einsum("be,wef->wbf", embed, filters.reshape(WIDTH, EMBED, FILTERS)).astype(np.float32)
        a = np.array([self.pooled(self.logits(c)) for c in every])
        self.mean, self.scale = a.mean(axis=0), a.std(axis=0) + 1e-6
        a = np.c_[(a - self.mean) / self.scale, np.ones(len(a))]
        self.beta = np.zeros(a.shape[1])
        weigh = np.where(label == 1, share / label.mean(), (1 - share) / (1 - label.mean()))  # as common as they are
        for _ in range(30):
            p = _sigmoid(a @ self.beta)
            h = (a * (weigh * p * (1 - p))[:, None]).T @ a + 0.5 * np.eye(len(self.beta))
            self.beta += np.linalg.solve(h, a.T @ (weigh * (label - p)) - 0.5 * self.beta)

    def logits(self, rows: np.ndarray) -> np.ndarray:
        """Logits of chunks."""
        out = np.empty(len(rows))
        for low in range(0, len(rows), 64):
            x = rows[low : low + 64].astype(np.intp)
            n = (CHUNK - WIDTH) // STRIDE + 1
            total = self.table[0][x[:, : n * STRIDE : STRIDE]]
            for w in range(1, WIDTH):
                total += self.table[w][x[:, w : w + n * STRIDE : STRIDE]]
            pooled = total.max(axis=1).astype(np.float64) + self.shift
            out[low : low + 64] = np.where(pooled > 0, pooled, 0.05 * pooled) @ self.dense + self.bias[0]
        return out

    @staticmethod
    def pooled(logit: np.ndarray) -> list[float]:
        return [logit.mean(), logit.max(), logit.min()]

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities of the texts of a block."""
        if self.table is None:
            return np.full(len(offsets) - 1, self.share)
        count, parts, held, size = [], [], [], 0
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            count.append(1 + max(0, -(-(b - a - CHUNK) // HOP)))
            for low in range(0, count[-1], SLAB):  # a long text is cut where chunks begin
                more = min(SLAB, count[-1] - low)
                held.append(chunks(data[a + low * HOP : min(b, a + (low + more - 1) * HOP + CHUNK)]))
                size += more
                if size >= SLAB:
                    parts.append(self.logits(np.concatenate(held)))
                    held, size = [], 0
        logit = np.concatenate([*parts, *([self.logits(np.concatenate(held))] if held else [])])
        at = np.cumsum([0, *count])
        a = np.stack([np.add.reduceat(logit, at[:-1]) / np.diff(at), np.maximum.reduceat(logit, at[:-1]), np.minimum.reduceat(logit, at[:-1])], axis=1)
        return _sigmoid((a - self.mean) / self.scale @ self.beta[:-1] + self.beta[-1])


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Network:
    """A network from at most ``most`` texts of each label value, none of them held out."""
    known = labels.filter(F.col("quality").isNotNull() & ~held_out()).agg(F.avg(F.col("quality").cast("double"))).first()[0]
    return Network(sample(docs, labels, "quality", most, [0, 1]), 0.5 if known is None else known)


def _scored(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network: Network = shared.value
        for batch in batches:
            for i, j, data, offsets in T.blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(network.scores(data, offsets))], names=["doc_id", "score"])

    return run


def quality(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score."""
    spark = ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_scored(spark.sparkContext.broadcast(network)), "doc_id bigint, score double")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = quality(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
