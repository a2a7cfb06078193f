import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cairnrank.llm.suffix_dedup import RunIndex, op3_suffix_dedup, repeated_starts, without_repeats


def brute(texts, length):
    """Kept bytes and removed runs of each text."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone[1:-1]])).hexdigest()))
    return out


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh"])
def test_index_finds_what_repeats(alphabet):
    rng = random.Random(7)
    for _ in range(60):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 60))).encode() for _ in range(rng.randint(1, 6))]
        seen = Counter(t[i : i + 5] for t in texts for i in range(len(t) - 4))
        for t, (lo, hi) in zip(texts, repeated_starts([np.frombuffer(t, np.uint8) for t in texts], 5), strict=True):
            got = {i for a, b in zip(lo, hi, strict=True) for i in range(a, b + 1)}
            assert got == {i for i in range(len(t) - 4) if seen[t[i : i + 5]] > 1}


def test_index_is_compressed_and_confirms_bytes(thue_morse):
    text = (b"some words that come again and again, " * 40)
    s = np.frombuffer(text, np.uint8).astype(np.int16) + 1
    index = RunIndex(np.append(s, 0).astype(np.int16), 20)
    assert index.length.sum() == len(s) + 1 and 10 * len(index.symbol) < len(s)
    # strings that differ but have equal polynomial hashes
    a, b = (x.encode() for x in thue_morse)
    texts = [b"x" * 9 + a, b"y" * 9 + b, a[:900] + b"z"]
    for t, (lo, hi) in zip(texts, repeated_starts([np.frombuffer(t, np.uint8) for t in texts], 600), strict=True):
        seen = Counter(u[i : i + 600] for u in texts for i in range(len(u) - 599))
        assert {i for x, y in zip(lo, hi, strict=True) for i in range(x, y + 1)} == {i for i in range(len(t) - 599) if seen[t[i : i + 600]] > 1}


@pytest.mark.parametrize("most_phrases", [8192, 2])
def test_against_brute_force(docs, most_phrases):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 6)))
    part = lambda n: " ".join(word() for _ in range(n))
    hot, other = part(20), part(12)
    rows = [(0, None), (1, ""), (2, "short"), (3, "xy" * 60), (4, "xyz" * 40), (None, part(9) + hot), (5, hot + hot)]
    for k in range(6, 40):
        rows.append((k, part(rng.randint(0, 8)) + rng.choice([hot, other, hot[:70], other[10:], ""]) + part(rng.randint(0, 8))))
    rows += [rows[10], rows[10], (10, "another text " + other)]
    got = without_repeats(docs(rows), length=30, most_phrases=most_phrases).collect()
    have = sorted((str(r["doc_id"]), r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in got)
    want = brute([(t or "").encode() for _, t in rows], 30)
    assert have == sorted((str(i), *w) for (i, _), w in zip(rows, want, strict=True))


def test_empty_table(docs):
    assert without_repeats(docs([])).collect() == []


def test_query_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = brute([r["text"].encode() for r in rows], 400)
    got = op3_suffix_dedup(spark, "/root/testdata/sf0.001").collect()
    assert sorted(tuple(r) for r in got) == sorted((r["doc_id"], *w) for r, w in zip(rows, want, strict=True))
