import random

import pytest

from cairnrank.llm.decontaminate import Automaton, decontaminate, hit_spans, words_of


def brute(words, items, window):
    hit, names = [False] * len(words), set()
    for name, item in items:
        k = min(window, len(item))
        for s in range(len(item) - k + 1 if k else 0):
            for i in range(len(words) - k + 1):
                if words[i : i + k] == item[s : s + k]:
                    hit[i : i + k] = [True] * k
                    names.add(name)
    return hit, names


@pytest.mark.parametrize("alphabet", ["ab", "abcd"])
def test_automaton_against_brute_force(alphabet):
    rng = random.Random(5)
    for _ in range(300):
        make = lambda n: [rng.choice(alphabet).encode() for _ in range(n)]
        items = [(str(k), make(rng.randint(0, 9))) for k in range(rng.randint(1, 6))]
        auto = Automaton(items, 4)
        for _ in range(5):
            words = make(rng.randint(0, 25))
            hit, names = brute(words, items, 4)
            found = auto.match(words)
            assert (found is None) == (not any(hit))
            if found:
                assert found[0].tolist() == hit and found[1] == names


@pytest.mark.parametrize("most", [200_000, 3])
def test_operator(spark, docs, most):
    items = [(1, "one two three four five"), (2, "Short item"), (None, "x y z w"), (4, None), (5, "..."), (2, "other thing")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [
        (0, None), (1, ""), (2, "a ONE, two three-four b"), (3, "short\nitem short item"), (None, "x y z w"), (5, "clean words only here"),
        (6, "one two three four five one two three"), (7, "other thing, thing other"), (7, "other thing, thing other"),
    ]
    got = hit_spans(docs(rows), bench, window=4, most_words=most).collect()
    named = [("null" if i is None else str(i), words_of((t or "").encode())) for i, t in items]
    for r in got:
        words = words_of((r["text"] or "").encode())
        hit, names = brute(words, named, 4)
        assert r["n_words"] == len(words)
        assert [any(s["start"] <= k < s["stop"] for s in r["spans"]) for k in range(len(words))] == hit
        assert r["items"] == sorted(names)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    left = {(r["doc_id"], r["text"], r["n"]) for r in decontaminate(docs(rows), bench, window=4, coverage=0.7, most_words=most).collect()}
    assert left == {(0, None, "x"), (1, "", "x"), (2, "a  b", "x"), (5, "clean words only here", "x"), (6, " one two three", "x"), (7, ", thing other", "x")}


def test_empty_tables(spark, docs):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert hit_spans(docs([]), bench).collect() == []
    assert [r["spans"] for r in hit_spans(docs([(1, "a b c")]), bench).collect()] == [[]]


@pytest.mark.parametrize("most", [200_000, 12])
def test_cut_and_coverage_over_all_automata(spark, docs, most):
    w = [f"w{k}" for k in range(16)]
    c, d, e = ([f"{x}{k}" for k in range(12)] for x in "cde")
    bench = spark.createDataFrame([(1, " ".join(w[1:11])), (2, " ".join(w[6:16])), (3, " ".join(c)), (4, " ".join(d)), (5, "end here")], "item_id bigint, text string")
    rows = [
        (0, "a " + " ".join(w[1:16]) + " " + " ".join(f"x{k}" for k in range(20))),  # overlapping items
        (1, " ".join([*c, *d, *e[:4], *(f"y{k}" for k in range(16))])),  # 12 of 44 and 12 of 44, together over a half
        (2, " ".join(["end", *c, "here", *e, *(f"y{k}" for k in range(16))])),  # what is left must not match anew
    ]
    rows = sorted((r["doc_id"], r["text"].split(), r["n"]) for r in decontaminate(docs(rows), bench, most_words=most).collect())
    assert rows == [(0, ["a", *(f"x{k}" for k in range(20))], "x"), (2, ["end", "here", *e, *(f"y{k}" for k in range(16))], "x")]
