"""Language identification of spans: script ranges, word scores, and a Viterbi path with a switching penalty.

A word is a run of letters. The script of its letters leaves the languages that were seen to use it; each of these has
a score for the word from a character trigram model (with word ends), learnt from a bounded sample. The best path of
languages over a text's words, at ``PENALTY`` nats a switch, labels its spans. The text's language is the one with most
letters on the path; the score is its share of them times its posterior share against the other languages.

Most texts have one language, and then no path needs to be searched: if no run of words favours another language by
more than half the penalty, staying is best. Word scores are computed once for each distinct word of a worker's table.

Defined cases: null texts and texts without a letter are ``und`` with score 0; words in a script of no learnt language
favour none, and a text of nothing else gets the commonest language with a score of 0; repeated rows are each labelled.
An empty table gives an empty table. Without any training row all is ``und``. Columns but id and text are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnrank.llm import text as T
from cairnrank.llm.training import held_out, sample
from cairnrank.session import ship

#: Texts a language to learn from, at most; nats a switch costs; least share of a language's letters for a script.
SAMPLE, PENALTY, USED = 800, 14.0, 0.001
#: Words of a worker's table.
KEPT = 80_000
BUCKETS = 1 << 17
#: First code points of script ranges, and the script from there on. Fixed values.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"),
    (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x2C60, "latin"), (0x2C80, "other"), (0x2DE0, "cyrillic"),
    (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"),
    (0xA640, "cyrillic"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0x10000, "other"), (0x20000, "han"),
)
_NAMES = sorted({s for _, s in SCRIPTS})
_FROM = np.array([a for a, _ in SCRIPTS])
_SCRIPT = np.array([_NAMES.index(s) for _, s in SCRIPTS])
_U = np.uint64
_WORD = T.ALNUM.copy()
_WORD[48:58] = False


def letters_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words' letters in lower case, and offsets by word."""
    text = "\n".join(w.decode("utf-8", "ignore") for w in words).lower().replace("̇", "") + "\n"
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, inverse = np.unique(code, return_inverse=True)
    keep = np.array([c == 10 or chr(c).isalpha() for c in kinds.tolist()], bool)[inverse]
    code = code[keep]
    end = np.flatnonzero(code == 10)
    return code[code != 10], np.concatenate([[0], end - np.arange(len(end))])


def trigrams(code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each letter's (and each word end's) trigram and of its context; and offsets by word."""
    size = np.diff(at)
    n = np.where(size > 0, size + 1, 0)
    out = np.concatenate([[0], np.cumsum(n)])
    # each word behind two marks, then a mark at its end
    width = np.where(size > 0, size + 3, 0)
    begin = np.concatenate([[0], np.cumsum(width)])
    padded = np.full(begin[-1], 10, np.uint64)
    owner = np.repeat(np.arange(len(size)), size)
    padded[begin[owner] + 2 + np.arange(len(code)) - at[owner]] = code
    word = np.repeat(np.arange(len(size)), n)
    p = begin[word] + 2 + np.arange(out[-1]) - out[word]
    context = T.mix(padded[p - 2] * _U(0x100000001B3) + padded[p - 1])
    return (T.mix(context * _U(0xD1342543DE82EF95) + padded[p]) % _U(BUCKETS)).astype(np.int64), (context % _U(BUCKETS)).astype(np.int64), out


class Model:
    """Scores of words by language."""

    def __init__(self, rows: list[tuple]):
        self.langs = sorted({r[2] for r in rows}, key=str.encode)
        self.key = uuid.uuid4().hex
        tri = np.zeros((BUCKETS, len(self.langs)), np.float32)
        bi, scripts = tri.copy(), np.zeros((len(_NAMES), len(self.langs)))
        self.prior = np.zeros(len(self.langs))
        for _, text, lang in rows:
            k = self.langs.index(lang)
            data = np.frombuffer((text or "").encode(), np.uint8)
            starts, ends, _ = T.word_spans(data, np.array([0, len(data)]), _WORD)
            raw = data.tobytes()
            code, at = letters_of([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
            t, c, _ = trigrams(code, at)
            np.add.at(tri[:, k], t, 1)
            np.add.at(bi[:, k], c, 1)
            np.add.at(scripts[:, k], _SCRIPT[np.searchsorted(_FROM, code, "right") - 1], 1)
            self.prior[k] += 1
        self.score = np.log(tri + 0.05)
        self.context = np.log(bi + 0.05 * 60)
        self.uses = scripts > USED * np.maximum(1, scripts.sum(axis=0))

    def words(self, words: list[bytes]) -> np.ndarray:
        """For each word a row: scores by language, less the best; its letters; its letters of no learnt script."""
        code, at = letters_of(words)
        t, c, out = trigrams(code, at)
        n = len(self.langs)
        rows = np.zeros((len(words), n + 2), np.float32)
        full = np.flatnonzero(np.diff(at) > 0)
        if not len(full) or not n:
            return rows
        rows[full, :n] = np.add.reduceat(self.score[t] - self.context[c], out[:-1][full], axis=0)
        rows[:, n] = np.diff(at)
        script = _SCRIPT[np.searchsorted(_FROM, code, "right") - 1]
        for k in np.unique(script).tolist():
            has = np.zeros(len(words), np.int64)
            has[full] = np.add.reduceat((script == k).astype(np.int64), at[:-1][full])
            if not self.uses[k].any():
                rows[:, n + 1] += has
            else:  # languages that don't use the script
                rows[np.ix_(has > 0, np.flatnonzero(~self.uses[k]))] -= 25
        rows[:, :n] = np.maximum(rows[:, :n] - rows[:, :n].max(axis=1, keepdims=True), -25)
        rows[rows[:, n] == rows[:, n + 1], :n] = 0
        return rows

    def path(self, scores: np.ndarray) -> np.ndarray:
        """The best language of each word."""
        n, langs = scores.shape
        back = np.zeros((n, langs), np.int8 if langs < 128 else np.int32)
        v = scores[0].astype(np.float64)
        stay = np.arange(langs)
        for t in range(1, n):
            top = int(v.argmax())
            move = v[top] - PENALTY > v
            back[t] = np.where(move, top, stay)
            v = np.where(move, v[top] - PENALTY, v) + scores[t]
        out = np.zeros(n, np.int64)
        out[-1] = v.argmax()
        for t in range(n - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out

    def label(self, table: T.WordTable, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, list[list[dict]]]:
        """Language, score and spans (byte places in each text) of the texts of a block."""
        count, n = len(offsets) - 1, len(self.langs)
        starts, ends, at = T.word_spans(data, offsets, _WORD)
        rows = table.of(T.LOWER[data], starts, ends)
        rows = table.rows[rows]
        scores, letters = rows[:, :n].astype(np.float64), rows[:, n].astype(np.int64)
        names, share, spans = ["und"] * count, np.zeros(count), [[] for _ in range(count)]
        full = np.flatnonzero(np.diff(at) > 0)
        if not len(full) or not n:
            return names, share, spans
        total = np.add.reduceat(scores, at[:-1][full], axis=0)
        sums = np.add.reduceat(letters, at[:-1][full])
        foreign = np.add.reduceat(rows[:, n + 1].astype(np.int64), at[:-1][full])
        best = (total + 1e-9 * self.prior).argmax(axis=1)
        # the most that any run of words gains by another language than the best
        order = np.repeat(np.arange(len(full)), np.diff(at)[full])
        gain = scores - np.take_along_axis(scores, best[order][:, None], axis=1)
        after = np.cumsum(gain, axis=0)
        after -= (after - gain)[at[:-1][full]][order]
        deep = order[:, None] * 1e9
        least = np.minimum.accumulate(after - gain - deep, axis=0) + deep
        most = np.maximum.reduceat((after - least).max(axis=1), at[:-1][full])
        for k, doc in enumerate(full.tolist()):
            if not sums[k]:
                continue
            lo, hi = at[doc], at[doc + 1]
            own = best[k]
            if most[k] <= PENALTY / 2:
                part, cut = 1.0, [(lo, hi, own)]
            else:
                path = self.path(scores[lo:hi])
                edge = np.concatenate([[0], np.flatnonzero(path[1:] != path[:-1]) + 1, [hi - lo]])
                cut = [(lo + a, lo + b, path[a]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                weight = np.bincount(path, letters[lo:hi], n)
                own = int(weight.argmax())
                part = weight[own] / sums[k]
            # against the others, over the words of its spans
            mine = sum(scores[a:b].sum(axis=0) for a, b, lang in cut if lang == own)
            rest = np.delete(mine, own) - mine[own]
            sure = 1 / (1 + np.exp(np.minimum(rest, 50)).sum())
            if foreign[k] == sums[k]:
                own, sure = int(self.prior.argmax()), 0.0
            names[doc], share[doc] = self.langs[own], part * sure * (1 - foreign[k] / sums[k])
            spans[doc] = [{"start": int(starts[a] - offsets[doc]), "stop": int(ends[b - 1] - offsets[doc]), "lang": self.langs[lang]} for a, b, lang in cut]
        return names, share, spans


def train(docs: DataFrame, most: int = SAMPLE, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from at most ``most`` texts of each language, none of them held out."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return Model(sample(rows, rows, "lang", most))


def _tools(shared) -> tuple[Model, T.WordTable]:
    """The broadcast model and this worker's table of its words."""
    model: Model = shared.value
    return T.kept(("language", model.key), lambda: (model, T.WordTable(model.words, len(model.langs) + 2, np.float32, KEPT)))


def _labelled(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = _tools(shared)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string())]))
        for batch in batches:
            for i, j, data, offsets in T.blocks(batch.column(1)):
                names, share, spans = model.label(table, data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(names), pa.array(share), pa.array(spans, kind)], names=["doc_id", "lang_pred", "score", "spans"])

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, spans (byte ranges of the text and their language)."""
    spark = ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_labelled(spark.sparkContext.broadcast(model)), "doc_id bigint, lang_pred string, score double, spans array<struct<start:bigint,stop:bigint,lang:string>>")


def _accepted(shared, at: int, least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = _tools(shared)
        for batch in batches:
            keep = []
            for _, _, data, offsets in T.blocks(batch.column(at)):
                names, share, _ = model.label(table, data, offsets)
                keep += [n != "und" and s >= least for n, s in zip(names, share.tolist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def accepted(docs: DataFrame, model: Model, least: float = 0.2, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text has a language with a score of ``least`` or more."""
    spark = ship(docs.sparkSession)
    return docs.mapInArrow(_accepted(spark.sparkContext.broadcast(model), docs.columns.index(text_col), least), docs.schema)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").cast("bigint").alias("n_spans"))
