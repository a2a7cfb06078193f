import random

import numpy as np
import pytest

from cairnrank.llm import near_dedup as N
from cairnrank.llm.skew import components


def brute(rows, size, percent=80):
    """n_shingles and component of each row, by all pairs of ids."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + min(size, len(w))]) for i in range(len(w) - min(size, len(w)) + 1)} if w else set())
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                up[y] = x
    return sorted((i, len(s), find(i), find(i) == i) for (i, _), s in zip(rows, sets, strict=True))


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("size", "chunk"), [(2, 256), (5, 256), (2, 16)])
def test_against_brute_force(docs, monkeypatch, size, chunk):
    monkeypatch.setattr(N, "CHUNK", chunk)
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    texts = [None, "", "  ", "one", "ONE", "one two", "Two one", *family(rng, text(120), 90, 22), *family(rng, text(60), 12, 5), *(text(rng.randint(1, 80)) for _ in range(60))]
    texts += texts[20:26]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = N.near_groups(docs([*rows, rows[7], (None, "one two"), (None, "alone here")]), shingle=size).collect()
    nulls = [tuple(r) for r in got if r["doc_id"] is None]
    assert sorted({tuple(r) for r in got if r["doc_id"] is not None}) == brute(rows, size)
    assert len(got) == len(rows) + 3
    assert sorted(n[2] or -1 for n in nulls) == [-1, min(i for i, t in rows if t == "one two")]


def test_registers_are_mergeable_and_estimate_similarity():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 900, dtype=np.uint64), rng.integers(0, 2**63, 900, dtype=np.uint64)
    flat = [np.unique(x) for x in (np.concatenate([a, b[:450]]), np.concatenate([a, b[450:]]), np.concatenate([a, b]))]
    at = np.cumsum([0, *map(len, flat)])
    regs = N.setsketch(np.concatenate(flat), at, 1000)
    assert (np.maximum(regs[0], regs[1]) == regs[2]).all()
    n = np.array([1350])
    ok, best = N.likely(regs[:1], regs[1:2], n, n, 0.55)
    assert ok[0] and abs(best[0] - 0.5) < 0.06
    ok, _ = N.likely(regs[:1], regs[1:2], n, n, 0.8)
    assert not ok[0]


def test_ids_of_several_texts_are_one_document(docs):
    one, two = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(3, one), (10, one), (10, two), (12, two), (12, ""), (14, "alone"), (None, two), (16, None), (16, "")]
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_groups(docs(rows), shingle=2).collect())
    assert got == [
        (0, 29, 3, False), (3, 29, 3, True), (10, 29, 3, False), (10, 29, 3, False), (12, 0, 3, False), (12, 29, 3, False), (14, 1, 14, True), (16, 0, 16, True), (16, 0, 16, True)
    ]


def test_words_that_a_polynomial_hash_takes_for_equal(docs, thue_morse):
    a, b = thue_morse
    texts = [a, b, f"{a} x", f"{b} x", f"x {a} {b}", f"x {b} {a}", f"{a} x"]
    got = {r["doc_id"]: r["component_id"] for r in N.near_groups(docs(list(enumerate(texts))), shingle=2).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 2}


def test_components_that_do_not_converge(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)], "a bigint, b bigint").repartition(7)
    assert {r["component"] for r in components(edges).collect()} == {0}
    with pytest.raises(RuntimeError):
        components(edges, rounds=0)


def test_empty_table(docs):
    assert N.near_groups(docs([])).collect() == []


def test_without(spark, docs):
    dropped = spark.createDataFrame([(2,)], "doc_id bigint")
    left = N.without(docs([(1, "a"), (2, "b"), (None, "c")]), dropped).collect()
    assert {r["doc_id"] for r in left} == {1, None}


def test_group_without_pairs():
    """A group in which every pair has one label has no candidates."""
    regs = N.pa.array([np.zeros(10, np.uint16).tobytes()] * 3, N.pa.binary())
    cols = {c: N.pa.array([0, 0, 0], N.pa.int64()) for c in ("key", "c", "s", "band", "side", "label", "rep", "cid", "n")}
    i, j, best = N._candidates(N.pa.table({**cols, "regs": regs}), np.zeros(3, np.int64), 10, 5, 0.8)
    assert len(i) == len(j) == len(best) == 0
