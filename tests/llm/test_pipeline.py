import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from cairnrank.llm.decontaminate import words_of
from cairnrank.llm.mixing import targets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after each stage, the input first."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("kept", F.lit("clash"))
    junk = spark.createDataFrame([(10**6, None, None, None, None, "j"), (10**6 + 1, "", "en", "src1", 0, "j"), (10**6 + 2, "123 !!", "en", "src1", 6, "j")], docs.schema)
    docs = docs.unionByName(junk)
    out = [docs.collect()]
    for k, (_, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        if k < len(P.STAGES) - 1:
            assert docs.columns == list(out[0][0].asDict())
            docs = spark.createDataFrame(rows, docs.schema)
        out.append(rows)
    return out


def test_language_keeps_clean_documents(stages):
    assert {r["doc_id"] for r in stages[0]} - {r["doc_id"] for r in stages[1]} == {10**6, 10**6 + 1, 10**6 + 2}


def test_near_dedup_against_brute_force(stages):
    sets = {}
    for r in stages[1]:
        w = r["text"].encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1)}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    assert sorted(r["doc_id"] for r in stages[2]) == sorted(i for i in sets if find(i) == i)


def test_decontamination_against_brute_force(spark, stages):
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words_of(r["text"].encode())
        k = min(10, len(w))
        windows |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1 if k else 0)}
    sizes = {len(w) for w in windows}
    after = {r["doc_id"]: r for r in stages[3]}
    for r in stages[2]:
        w = words_of(r["text"].encode())
        hit = [False] * len(w)
        for k in sizes:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit[i : i + k] = [True] * k
        assert (r["doc_id"] in after) == (2 * sum(hit) <= len(w))
        if r["doc_id"] in after:
            assert words_of(after[r["doc_id"]]["text"].encode()) == [x for x, h in zip(w, hit, strict=True) if not h]
            assert after[r["doc_id"]]["n_chars"] == len(after[r["doc_id"]]["text"])
            assert any(hit) or after[r["doc_id"]]["text"] == r["text"]


def test_mixing_meets_its_targets(stages):
    size, taken, own = {}, {}, {}
    for r in stages[3]:
        size[r["source"]] = size.get(r["source"], 0) + len(r["text"].encode().split())
        own[r["doc_id"]] = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
    for r in stages[4]:
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        taken[r["source"]] = taken.get(r["source"], 0) + len(words)
        it = iter(own[r["doc_id"]])
        assert words and all(w in it for w in words)  # in order, from that document
    names = sorted(size)
    for s, due in zip(names, targets([size[s] for s in names]), strict=True):
        assert abs(taken.get(s, 0) - due) <= max(64, 0.05 * due)


def test_tokens(stages):
    t = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
    want, before = [], 0
    for r in sorted(stages[4], key=lambda r: (r["doc_id"], r["text"])):
        ids = [*t.encode(r["text"], add_special_tokens=False).ids, 1]
        want.append((r["doc_id"], before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        before += len(ids)
    assert sorted(map(tuple, stages[5]), key=lambda r: r[1]) == want


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, SF)
        assert docs.collect() == []
        if k < len(P.STAGES) - 1:
            docs = spark.createDataFrame([], docs.schema)
