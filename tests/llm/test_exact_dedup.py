import hashlib

import pytest

from cairnrank.llm import exact_dedup as E
from cairnrank.llm.skew import components, join_groups

ROWS = [(0, None), (1, ""), (2, "Text"), (3, "tEXT"), (4, "texté"), (5, "TEXTÉ"), (6, "text "), (None, "alone"), (None, "text"), (7, "twice"), (7, "twice"), (8, "x" * 200_000)]


def brute(rows):
    group = {}
    for i, t in rows:
        group.setdefault((t or "").encode().lower(), []).append(i)
    best = {k: max((i for i in v if i is not None), default=None) for k, v in group.items()}
    out = []
    for i, t in rows:
        k = (t or "").encode().lower()
        out.append((i, best[k], len(group[k]), i == best[k], hashlib.sha256(k).digest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("per_row", [16, 1 << 16])
def test_against_brute_force(docs, monkeypatch, per_row):
    monkeypatch.setattr(E, "PER_ROW", per_row)  # the many counters of the second case take several slices
    rows = ROWS + [(k, f"text {k % 37}") for k in range(100, 400)]
    got = E.exact_groups(docs(rows), filter_mb=1).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], bytes(r["sha"])) for r in got), key=repr) == brute(rows)


def test_empty_table(docs):
    assert E.exact_groups(docs([])).collect() == []


def test_components(spark):
    import random

    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1080)] + [(2000, 2000 + k) for k in range(1, 60)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)).collect()
    want = {(x, find(x)) for a, b in edges if a != b for x in (a, b)}
    assert {(r["node"], r["component"]) for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_hot_groups_join(spark):
    rows = spark.createDataFrame([("hot", k) for k in range(40)] + [(f"g{k % 9}", k) for k in range(20)] + [("none", 1)], "g string, k int")
    groups = rows.filter("g <> 'none'").groupBy("g").count()
    inner, left = (join_groups(rows, groups, ["g"], "count", 61, how).collect() for how in ("inner", "left"))
    assert len(inner) == 60 and len(left) == 61 and {r["count"] for r in inner if r["g"] == "hot"} == {40}
