import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cairnrank.llm import text as T
from cairnrank.llm.token_output import Encoder, op6_token_output, open_tokens, read_tokens, sequence, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "a ́b É<|endoftext|>x  ΣΑΣ ΣΑΣ. b c\x1cd\x85e 'S it'S İ ﬁ", "", "  ", "ẛ̣ é \ń", "it's ... they're. '.s !'re x.́ ≮a re's'll",
    "a b  x y 12.5a", "I'M don't. (x)'s <|STARTOFTEXT|>", "ª º ﬀ Ω µ.", "\x00a\x00 b", "x" * 5000, "日本 語。テスト",
]


@pytest.fixture(scope="module")
def direct():
    t = Tokenizer.from_file(PATH)
    return lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 1]


def expected(rows, direct):
    out, before = [], 0
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = direct(x)
        out.append((i, before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        before += len(ids)
    return out


def test_encoder_agrees(direct):
    e = Encoder(PATH, 1)
    for i, j, data, offsets in T.blocks(pa.array(ODD * 2), 64):
        ids, count = e.encode(data, offsets)
        assert ids.tolist() == [x for t in (ODD * 2)[i:j] for x in direct(t)] and count.sum() == len(ids)


@pytest.mark.parametrize("alike", [False, True])
def test_words_that_a_polynomial_hash_takes_for_equal(direct, thue_morse, monkeypatch, alike):
    if alike:  # whatever the hash
        monkeypatch.setattr(T, "word_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    texts = [*thue_morse, " ".join(thue_morse), " ".join(thue_morse[::-1])]
    (_, _, data, offsets), = T.blocks(pa.array(texts))
    starts, ends, _ = T.word_spans(data, offsets, ~T.SPACE)
    assert len(np.unique(T.word_hashes(data, starts, ends))) == (1 if alike else 2)
    ids, count = Encoder(PATH, 1).encode(data, offsets)
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [direct(t) for t in texts]


def test_equal_spans():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 2, 30_000, dtype=np.uint8)
    data[15_000:27_000] = data[:12_000]
    a, size = rng.integers(0, 14_000, 500), rng.choice([0, 1, 7, 8, 9, 16, 300, 4096, 5000, 11_000], 500)
    b = np.where(rng.random(500) < 0.6, np.minimum(a + 15_000, 30_000 - size), rng.integers(0, 19_000, 500))
    want = [data[x : x + n].tobytes() == data[y : y + n].tobytes() for x, y, n in zip(a, b, size, strict=True)]
    assert T.same_spans(data, a, b, size).tolist() == want and 100 < sum(want) < 450


def test_small_table_changes_nothing(direct):
    e = Encoder(PATH, 1, 3)
    for text in ["a b c d e", "a a f g", "b c", "h i j a"] * 3:
        (_, _, data, offsets), = T.blocks(pa.array([text]))
        assert e.encode(data, offsets)[0].tolist() == direct(text)


def test_files(spark, docs, direct):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "no id"), (3, "again"), (3, "again"), (90, None)]
    folder, files = write_tokens(docs(rows), PATH, length=8)
    got = sorted((tuple(r) for r in read_tokens(spark, folder, files).collect()), key=lambda r: r[1])
    assert got == expected(rows, direct)
    stream = []
    for f in files:
        reader, _ = open_tokens(folder, f["path"])
        n = sum(reader.get_batch(k).num_rows for k in range(reader.num_record_batches))
        for k in range(n):
            ids, mask = sequence(reader, k)
            assert len(ids) == 8 and (mask.all() or k == n - 1)
            stream += ids[mask].tolist()
    assert len(stream) == sum(f["ids"] for f in files) == got[-1][1] + got[-1][2]


def test_empty_table(spark, docs):
    folder, files = write_tokens(docs([]), PATH)
    assert read_tokens(spark, folder, files).collect() == []


def test_query(spark, direct):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in op6_token_output(spark, "/root/testdata/sf0.001").collect())
    assert got == expected(rows, direct)
