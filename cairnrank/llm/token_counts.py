"""Token counts under a unigram model, by dynamic programming shared over a trie.

Pieces come from a public vocabulary file; a piece's score is the logarithm of its probability under Zipf's law for its
rank, as an integer in units of 2**-16. A pre-token is a run of bytes without white space behind the vocabulary's
word mark; its tokens are the pieces of the best-scoring split, the fewest if several score the same. Bytes that no
piece covers are byte pieces, as in the vocabulary. Distinct pre-tokens are taken in sorted order, which walks their
trie: forward scores stay for the prefix shared with the word before, and only the rest is computed. Each worker keeps
the counts at the trie's ends in a bounded table.

Defined cases: null and empty texts, and those of white space alone, have no tokens; an empty table gives an empty
table; repeated rows each count. Columns other than id and text are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnrank.llm import text as T
from cairnrank.session import ship

MARK = "▁".encode()


def pieces(path: str) -> dict[bytes, int]:
    """Scores of the pieces of a sentencepiece file; single bytes that are no piece have their byte piece's score."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out, byte = {}, {}
    for rank in range(model.get_piece_size()):
        name = model.id_to_piece(rank)
        score = -round(math.log(rank + 2) * 65536)
        if m := re.fullmatch("<0x([0-9A-F]{2})>", name):
            # worse than any piece, so that it only serves where nothing else does
            byte[bytes([int(m[1], 16)])] = -round(math.log(2 * model.get_piece_size()) * 65536) * 2
        elif not model.is_control(rank) and not model.is_unknown(rank):
            out[name.encode()] = score
    return byte | out


class Counter:
    def __init__(self, scores: dict[bytes, int]):
        self.scores, self.longest = scores, max(map(len, scores))
        self.table = T.WordTable(self.count, 1, np.int64)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word, by a walk of the trie of them all."""
        out = np.zeros((len(words), 1), np.int64)
        scores, longest = self.scores, self.longest
        best, number = [0], [0]  # by prefix length of the word at hand
        last = b""
        for k in sorted(range(len(words)), key=words.__getitem__):
            word = MARK + words[k]
            shared, most = 0, min(len(word), len(last))
            while shared < most and word[shared] == last[shared]:
                shared += 1
            del best[shared + 1 :], number[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, least = None, 0
                for begin in range(max(0, end - longest), end):
                    score = scores.get(word[begin:end])
                    if score is not None:
                        score += best[begin]
                        n = number[begin] + 1
                        if top is None or score > top or score == top and n < least:
                            top, least = score, n
                best.append(top)
                number.append(least)
            out[k, 0] = number[-1]
            last = word
        return out


def counter(path: str) -> Counter:
    return T.kept(("counter", path), lambda: Counter(pieces(path)))


def _counted(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for i, j, data, offsets in T.blocks(batch.column(1)):
                starts, ends, at = T.word_spans(data, offsets, ~T.SPACE)
                row = own.table.of(data, starts, ends)
                total = np.concatenate([[0], np.cumsum(own.table.rows[row, 0])])
                cols = [np.diff(offsets), np.diff(at), total[at[1:]] - total[at[:-1]]]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], *map(pa.array, cols)], names=["doc_id", "n_bytes", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_words (pre-tokens), n_tokens. No shuffle."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_counted(vocabulary), "doc_id bigint, n_bytes bigint, n_words bigint, n_tokens bigint")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
