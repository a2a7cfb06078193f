"""Toxicity by the nearest labelled examples, by exact TF-IDF cosine from a block-max inverted index.

A bounded sample of labelled texts is the index. Terms are words and their first bytes, of several lengths, as words vary in
their endings. The vocabulary has the terms whose presence is tied to the label beyond chance (|z| of some least value, at
most ``MOST_WORDS`` of them), so a text's length and topic don't hide what matters; all other terms of a text are one term
of a fixed weight, ``OTHER``, which keeps a single chance hit in a text apart from many. The least |z| is chosen from ``LEAST_Z`` by
the loss of each half of the sample under an index of the other. Each posting list carries its greatest weight in every
range of ``RANGE`` examples. A text's nearest ``NEAREST`` examples are found exactly: ranges are taken by descending bound
(its weights times those maxima) until no bound reaches the last neighbour held. Votes weigh by distance, and their share
is turned into a probability fitted on the sample itself, each example scored without itself, weighted to the label's
share among all labelled rows. Evidence: the nearest examples' ids, similarities and labels.

Defined cases: null and empty texts, and those with no term of the vocabulary, get the share of toxic examples among such
examples; ties go to the lower doc_id; repeated rows are each scored. An empty table gives an empty table; without
labels, or with one value only, all texts get that share. Labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnrank.llm.decontaminate import words_of
from cairnrank.llm.training import held_out, sample
from cairnrank.session import ship

#: Examples of a label value, at most; neighbours; examples of a range; terms of the vocabulary; evidence given; words whose
#: terms a worker keeps.
SAMPLE, NEAREST, RANGE, MOST_WORDS, EVIDENCE, KEPT = 3000, 31, 64, 4096, 3, 100_000
#: Least |z| of a term, one of which is chosen; weight of all other terms of a text; bytes of the stems.
LEAST_Z, OTHER, STEMS = (5.0, 6.0, 8.0), 6.0, range(3, 9)
#: The term that stands for all others; no word is empty.
REST = b""


def terms_of_word(word: bytes) -> list[bytes]:
    """A word, and behind a mark its beginnings of each length in ``STEMS``."""
    return [word, *(b"^" + word[:n] for n in STEMS if n < len(word))]


def terms_of(text: bytes) -> list[bytes]:
    return [t for w in words_of(text) for t in terms_of_word(w)]


class Corpus:
    """Examples as counts of words, and words as terms, by number: what indexes of all or some of them are made from."""

    def __init__(self, rows: list[tuple]):
        self.rows = sorted(rows)
        self.label = np.array([r[2] for r in self.rows], np.int64)
        words: dict[bytes, int] = {}
        terms: dict[bytes, int] = {}
        flat, size, self.docs = [], [], []
        for r in self.rows:
            bag = Counter(words_of((r[1] or "").encode()))
            for w in bag:
                if w not in words:
                    words[w] = len(words)
                    own = terms_of_word(w)
                    flat += [terms.setdefault(t, len(terms)) for t in own]
                    size.append(len(own))
            self.docs.append((np.fromiter(map(words.__getitem__, bag), np.int32, len(bag)), np.fromiter(bag.values(), np.int32, len(bag))))
        self.terms = list(terms)
        self.flat, self.at = np.array(flat, np.int32), np.cumsum([0, *size])

    def terms_in(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Terms of an example, once for each of its words, and the word's count."""
        word, count = self.docs[k]
        size = self.at[word + 1] - self.at[word]
        place = np.repeat(self.at[word] + size - np.cumsum(size), size) + np.arange(size.sum())
        return self.flat[place], np.repeat(count, size)

    def document_counts(self, pick: np.ndarray) -> np.ndarray:
        """Of the examples ``pick``: how many have each term."""
        out = np.zeros(len(self.terms), np.int64)
        for k in pick.tolist():
            out[np.unique(self.terms_in(k)[0])] += 1
        return out


class Index:
    """Block-max inverted index of the examples, with the fitted probability."""

    def __init__(self, rows: list[tuple], share: float, least: float | None = None, corpus: Corpus | None = None, pick: np.ndarray | None = None):
        corpus = corpus or Corpus(rows)
        pick = np.arange(len(corpus.rows)) if pick is None else pick
        self.ids = np.array([corpus.rows[k][0] for k in pick.tolist()], np.int64)
        self.label = corpus.label[pick]
        self.known: dict[bytes, list[int]] = {}
        self.least = chosen(corpus, share) if least is None else least
        n, toxic = len(pick), int(self.label.sum())
        yes, no = corpus.document_counts(pick[self.label == 1]), corpus.document_counts(pick[self.label != 1])
        z = np.zeros(len(yes))
        if toxic and n - toxic:
            p = (yes + no) / n
            some = (p > 0) & (p < 1)
            z[some] = np.abs(yes[some] / toxic - no[some] / (n - toxic)) / np.sqrt(p[some] * (1 - p[some]) * (1 / toxic + 1 / (n - toxic)))
        found = sorted((-z[t], corpus.terms[t], t) for t in np.flatnonzero(z >= self.least).tolist())[:MOST_WORDS]
        self.vocab = {w: k for k, (_, w, _) in enumerate(found)}
        self.vocab[REST] = len(self.vocab)
        self.idf = np.array([*(np.log((n + 1) / (yes[t] + no[t])) for _, _, t in found), 0.0])
        #: Place in the vocabulary of each term of the corpus; not kept.
        place = np.full(len(corpus.terms), -1)
        place[[t for _, _, t in found]] = np.arange(len(found))
        lists: list[list[tuple[int, float]]] = [[] for _ in self.vocab]
        vectors = []
        for k in range(n):
            vectors.append(self.of_example(corpus, int(pick[k]), place))
            for t, x in zip(*vectors[-1], strict=True):
                lists[t].append((k, x))
        at = np.cumsum([0, *map(len, lists)])
        self.post = np.array([k for x in lists for k, _ in x], np.int64)
        self.weight = np.array([x for y in lists for _, x in y])
        self.ranges = -(-n // RANGE)
        self.most = np.zeros((len(self.vocab), self.ranges))
        np.maximum.at(self.most, (np.repeat(np.arange(len(lists)), np.diff(at)), self.post // RANGE), self.weight)
        #: Where the postings of each term in each range begin.
        self.cut = np.stack([low + np.searchsorted(self.post[low:high], np.arange(self.ranges + 1) * RANGE) for low, high in zip(at, at[1:], strict=False)])
        self._fit(vectors, share)

    def of_example(self, corpus: Corpus, k: int, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``vector`` of an example of the corpus; ``place``: of its terms in the vocabulary."""
        if place is None:
            place = np.fromiter((self.vocab.get(t, -1) for t in corpus.terms), np.int64, len(corpus.terms))
        term, count = corpus.terms_in(k)
        here = place[term] >= 0
        total = np.bincount(place[term[here]], count[here], 1).astype(np.int64)
        there = np.flatnonzero(total)
        return self._weighed(dict(zip(there.tolist(), total[there].tolist(), strict=True)))

    def vector(self, bag: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """Terms and unit-length TF-IDF weights of a bag of terms; none if it has no term of the vocabulary."""
        return self._weighed({self.vocab[w]: c for w, c in bag.items() if w in self.vocab})

    def _weighed(self, count: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        if not count:
            return np.zeros(0, np.int64), np.zeros(0)
        t = np.array(sorted(count), np.int64)
        x = np.log1p(np.array([count[k] for k in t.tolist()], float)) * self.idf[t]
        t, x = np.append(t, self.vocab[REST]), np.append(x, OTHER)
        return t, x / np.sqrt((x * x).sum())

    def of_text(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """``vector`` of a text's terms; those of each word are looked up once."""
        if len(self.known) > KEPT:
            self.known.clear()
        count: dict[int, int] = {}
        for word, times in Counter(words_of(text)).items():
            if (own := self.known.get(word)) is None:
                own = self.known[word] = [self.vocab[t] for t in terms_of_word(word) if t in self.vocab]
            for k in own:
                count[k] = count.get(k, 0) + times
        return self._weighed(count)

    def nearest(self, t: np.ndarray, x: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The nearest examples with a similarity over 0 (all but ``without``), and their similarities."""
        if not len(t):
            return np.zeros(0, np.int64), np.zeros(0)
        bound = x @ self.most[t]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        near, score, done = np.zeros(0, np.int64), np.zeros(0), 0
        while done < len(order):
            if len(near) == NEAREST and bound[order[done]] < score[-1] - 1e-12:
                break
            # a few ranges at once; exact sums of their postings
            take = order[done : done + 8]
            done += len(take)
            a = self.cut[t[:, None], take]
            size = (self.cut[t[:, None], take + 1] - a).ravel()
            place = np.repeat(a.ravel() + size - np.cumsum(size), size) + np.arange(size.sum())
            slot = np.repeat(np.tile(np.arange(len(take)) * RANGE, len(t)), size) + self.post[place] % RANGE
            value = np.bincount(slot, np.repeat(np.repeat(x, len(take)), size) * self.weight[place], len(take) * RANGE)
            there = np.flatnonzero(value > 0)
            who = take[there // RANGE] * RANGE + there % RANGE
            there, who = there[who != without], who[who != without]
            near, score = np.concatenate([near, who]), np.concatenate([score, np.round(value[there], 12)])
            best = np.lexsort((near, -score))[:NEAREST]
            near, score = near[best], score[best]
        return near, score

    @staticmethod
    def features(label: np.ndarray, score: np.ndarray) -> list[float]:
        """Distance-weighted share of toxic neighbours, the greatest similarity, and 1."""
        w = 1 / (1.02 - score)
        return [float((w * label).sum() / w.sum()), float(score[0]), 1.0]

    def _fit(self, vectors: list[tuple], share: float) -> None:
        toxic = self.label.mean() if len(self.label) else 0.0
        weigh = np.where(self.label == 1, share / max(toxic, 1e-9), (1 - share) / max(1 - toxic, 1e-9))
        rows, ys, ws, none = [], [], [], [0.5 * share, 0.5]
        for k, (t, x) in enumerate(vectors):
            near, score = self.nearest(t, x, k)
            if len(near):
                rows.append(self.features(self.label[near], score))
                ys.append(self.label[k])
                ws.append(weigh[k])
            else:
                none[0] += weigh[k] * self.label[k]
                none[1] += weigh[k]
        self.base = none[0] / none[1]
        self.beta = np.zeros(3)
        if rows:
            a, y, w = np.array(rows), np.array(ys, float), np.array(ws)
            for _ in range(30):  # Newton steps of a ridge logistic regression
                p = 1 / (1 + np.exp(-a @ self.beta))
                h = (a * (w * p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(3)
                self.beta += np.linalg.solve(h, a.T @ (w * (y - p)) - 0.05 * self.beta)

    def score(self, text: bytes) -> tuple[float, list[dict]]:
        p, near, score = self.judged(*self.of_text(text))
        pick = zip(near[:EVIDENCE].tolist(), score[:EVIDENCE].tolist(), strict=True)
        return p, [{"doc_id": int(self.ids[k]), "similarity": s, "toxic": int(self.label[k])} for k, s in pick]

    def judged(self, t: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Probability, neighbours and similarities of a vector."""
        near, score = self.nearest(t, x)
        if not len(near):
            return self.base, near, score
        return float(1 / (1 + np.exp(-np.dot(self.features(self.label[near], score), self.beta)))), near, score


def chosen(corpus: Corpus, share: float) -> float:
    """The least |z| under which each half of the examples foretells the labels of the other best."""
    label = corpus.label
    if len(label) < 4 or not 0 < label.mean() < 1:
        return LEAST_Z[-1]
    part = np.zeros(len(label), np.int64)
    for y in (0, 1):  # every second one of each value
        part[label == y] = np.arange((label == y).sum()) % 2
    weigh = np.where(label == 1, share / label.mean(), (1 - share) / (1 - label.mean()))
    loss = []
    for least in LEAST_Z:
        total = 0.0
        for k in (0, 1):
            index = Index([], share, least, corpus, np.flatnonzero(part != k))
            place = np.fromiter((index.vocab.get(t, -1) for t in corpus.terms), np.int64, len(corpus.terms))
            for i in np.flatnonzero(part == k).tolist():
                p = np.clip(index.judged(*index.of_example(corpus, i, place))[0], 1e-4, 1 - 1e-4)
                total -= weigh[i] * np.log(p if label[i] else 1 - p)
        loss.append(total)
    return LEAST_Z[int(np.argmin(loss))]


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Index:
    """An index of at most ``most`` examples of each label value, none of them held out."""
    known = labels.filter(F.col("toxic").isNotNull() & ~held_out()).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    return Index(sample(docs, labels, "toxic", most, [0, 1]), known or 0.0)


def _scored(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
        for batch in batches:
            got = [index.score(x or b"") for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], kind)], names=["doc_id", "score", "evidence"])

    return run


def toxicity(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score, evidence."""
    spark = ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_scored(spark.sparkContext.broadcast(index)), "doc_id bigint, score double, evidence array<struct<doc_id:bigint,similarity:double,toxic:int>>")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")
