import numpy as np

from cairnrank.llm.mixing import mix, mixed_documents, op5_mixing, permuted, targets


def test_targets():
    assert targets([]) == []
    assert targets([100, 100, 100]) == [300 * 5 / 8, 300 * 2 / 8, 300 / 8]
    got = targets([10, 200, 400, 0])
    assert got[0] == 30 and got[3] == 0 and abs(sum(got) - 610) < 1e-9 and abs(got[1] / got[2] - 2) < 1e-9


def test_permutation():
    for n in (1, 2, 3, 7, 64, 1000):
        x = np.arange(n)
        got = permuted(x, np.full(n, n), np.full(n, 12345))
        assert sorted(got.tolist()) == x.tolist()
    assert permuted(np.arange(500), np.full(500, 500), np.full(500, 9)).tolist() != list(range(500))


def rows():
    out = [(None, None, "a"), (1, "", None), (2, "one", None), (3, "  two words ", "a"), (4, "x " * 5000, "b")]
    out += [(k, " ".join(f"w{k}.{i}" for i in range(k % 50)), "abc"[k % 3] if k % 7 else None) for k in range(5, 300)]
    return out + [out[40], out[40]]


def test_pieces(spark):
    docs = spark.createDataFrame(rows(), "doc_id int, text string, source string").withColumnRenamed("doc_id", "doc_id")
    texts, pieces = mix(docs, block=8)
    t = {r["row"]: r for r in texts.collect()}
    p = pieces.collect()
    assert len(t) == len(rows())
    words = dict.fromkeys(t, 0)
    for r in p:
        assert 0 <= r["first"] and r["first"] + r["words"] <= t[r["row"]]["size"] and 0 < r["words"] <= 8
        words[r["row"]] += r["words"]
    assert all(words[k] <= 3 * r["size"] for k, r in t.items())
    by = {}
    for k, r in t.items():
        by.setdefault(r["source"], [0, r["target"]])[0] += words[k]
    assert all(abs(got - due) <= 2 * 8 for got, due in by.values())
    again = mix(docs, block=8)[1].collect()
    key = lambda r: (r["shard"], r["slot"], r["first"], r["words"], t[r["row"]]["doc_id"] or -1)
    assert sorted(map(key, again)) == sorted(map(key, p))


def test_documents(spark):
    docs = spark.createDataFrame([(i, t, s, len(t or "")) for i, t, s in rows()], "doc_id int, text string, source string, n_chars bigint")
    out = mixed_documents(docs, block=8).collect()
    _, pieces = mix(docs, block=8)
    assert sum(len((r["text"] or "").split()) for r in out) == sum(r["words"] for r in pieces.collect())
    whole = {(r["doc_id"], r["source"]) for r in docs.collect()}
    assert {(r["doc_id"], r["source"]) for r in out} <= whole and all(r["n_chars"] == len(r["text"]) for r in out)


def test_columns_with_names_of_its_own(spark):
    rows = [(k, f"word{k} " * 90, "ab"[k % 2], "h", "i", "m", "t", "r") for k in range(30)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id bigint, text string, source string, _HASH string, _doc_id string, _mark string, _taken string, _rows string")
    got = mixed_documents(docs).collect()
    assert got[0].asDict().keys() == set(docs.columns) and {tuple(r)[3:] for r in got} == {("h", "i", "m", "t", "r")}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id int, text string, source string")
    texts, pieces = mix(docs)
    assert texts.collect() == [] and pieces.collect() == [] and mixed_documents(docs).collect() == []


def test_query(spark):
    got = op5_mixing(spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(docs)
    size, due, taken = {}, {}, {}
    for r in got:
        x = docs[r["doc_id"]]
        assert r["size"] == len(x["text"].encode().split()) and r["taken"] <= 3 * r["size"]
        size[x["source"]] = size.get(x["source"], 0) + r["size"]
        taken[x["source"]] = taken.get(x["source"], 0) + r["taken"]
        due[x["source"]] = r["target"]
    names = sorted(size)
    assert [due[s] for s in names] == targets([size[s] for s in names])
    assert all(abs(taken[s] - due[s]) <= max(64, 0.05 * due[s]) for s in names)
    assert all(r["source_size"] == size[docs[r["doc_id"]]["source"]] for r in got)
