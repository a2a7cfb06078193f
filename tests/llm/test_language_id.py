import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnrank.llm import language_id as L


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    russian = spark.createDataFrame([(10**6 + k, "это русский текст о языках и словах", "ru") for k in range(9)], docs.schema)
    return L.train(docs.unionByName(russian))


def test_best_path_is_best():
    rng = np.random.default_rng(2)
    m = object.__new__(L.Model)
    for _ in range(60):
        scores = -rng.random((rng.integers(1, 7), 3)) * 30
        cost = lambda p, s=scores: s[np.arange(len(p)), list(p)].sum() - L.PENALTY * sum(a != b for a, b in itertools.pairwise(p))
        assert abs(cost(m.path(scores)) - max(cost(p) for p in itertools.product(range(3), repeat=len(scores)))) < 1e-9


def test_shortcut_agrees_with_search(spark, docs, model):
    rng = random.Random(4)
    words = {k: t.split() for k, t in (("en", "the thing was that of and with there"), ("de", "und der die schlich ung keit über"), ("fr", "les queaux était une pour éelle"))}
    texts = [" ".join(" ".join(rng.choices(words[rng.choice("en de fr".split())], k=rng.randint(1, 12))) for _ in range(rng.randint(1, 4))) for _ in range(200)]
    table = lambda: L.T.WordTable(model.words, len(model.langs) + 2, np.float32)
    (_, _, data, at), = L.T.blocks(L.pa.array(texts))
    fast = model.label(table(), data, at)
    penalty, L.PENALTY = L.PENALTY, L.PENALTY
    for k, text in enumerate(texts):
        ws = text.encode().split()
        rows = model.words([w.lower() for w in ws]).astype(float)
        path = model.path(rows[:, : len(model.langs)])
        runs = [(model.langs[a], len(list(b))) for a, b in itertools.groupby(path.tolist())]
        assert [s["lang"] for s in fast[2][k]] == [a for a, _ in runs]
    L.PENALTY = penalty


def test_cases(docs, model):
    rows = [(0, None), (1, ""), (2, "12 34 ... !"), (3, "это русские слова"), (4, "日本語のテキスト"), (None, "the thing was that"), (6, "the thing was that"), (6, "the thing was that"), (7, "x" * 70000)]
    got = {(r["doc_id"], r["lang_pred"], round(r["score"], 3) > 0) for r in L.identify(docs(rows), model).collect()}
    assert {(0, "und", False), (1, "und", False), (2, "und", False), (3, "ru", True), (None, "en", True), (6, "en", True)} <= got
    assert next(x for x in got if x[0] == 4)[1:] == ("en", False)
    left = L.accepted(docs(rows), model).collect()
    assert {r["doc_id"] for r in left} >= {3, None, 6} and not {0, 1, 2, 4} & {r["doc_id"] for r in left}


def test_spans_of_mixed_text(docs, model):
    text = "the thing that was there with the tionthing and then " * 3 + "und der die keit schlich ung über einheit " * 3
    (r,) = L.identify(docs([(1, text)]), model).collect()
    assert [s["lang"] for s in r["spans"]] == ["en", "de"]
    assert text.encode()[r["spans"][1]["start"] :].startswith(b"und der")


def test_empty_table(spark, docs, model):
    assert L.identify(docs([]), model).collect() == []
    none = L.train(docs([]).withColumn("lang", F.lit(None).cast("string")))
    assert [r["lang_pred"] for r in L.identify(docs([(1, "word")]), none).collect()] == ["und"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.op7_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
