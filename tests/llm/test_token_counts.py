import public_tokenizers

from cairnrank.llm.token_counts import MARK, Counter, op2_token_counts, pieces, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(text, scores, longest):
    total = 0
    for word in (text or "").encode().split():
        word = MARK + word
        best = [(0, 0)]
        for end in range(1, len(word) + 1):
            best.append(max((best[b][0] + scores[word[b:end]], best[b][1] - 1) for b in range(max(0, end - longest), end) if word[b:end] in scores))
        total -= best[-1][1]
    return total


def test_against_brute_force(spark, docs):
    rows = [(0, None), (1, ""), (2, " \n"), (3, "the theatre, then thé 日本語 \x00\x1c"), (None, "the the"), (5, "x" * 3000), (5, "x" * 3000), (6, "abc abd ab abcde")]
    scores = pieces(PATH)
    longest = max(map(len, scores))
    got = token_counts(docs(rows), PATH).collect()
    have = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_words"], r["n_tokens"]) for r in got)
    assert have == sorted((i is None, i or 0, len((t or "").encode()), len((t or "").encode().split()), brute(t, scores, longest)) for i, t in rows)


def test_words_that_a_polynomial_hash_takes_for_equal(docs, thue_morse):
    scores = pieces(PATH)
    longest = max(map(len, scores))
    rows = [(k, t) for k, t in enumerate([*thue_morse, "ab ba", "ba ab"])]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(docs(rows), PATH).collect()}
    assert got == {k: brute(t, scores, longest) for k, t in rows}


def test_small_table_changes_nothing():
    own = Counter(pieces(PATH))
    own.table.most = 2
    words = [b"alpha", b"beta", b"alphabet", b"be", b"gamma"]
    want = [brute(w.decode(), own.scores, own.longest) for w in words]
    for _ in range(4):
        for k in range(0, 5, 2):
            at = own.table.look_up(words[k : k + 2])
            assert own.table.rows[at, 0].tolist() == want[k : k + 2]


def test_empty_table(docs):
    assert token_counts(docs([]), PATH).collect() == []


def test_query(spark):
    scores = pieces(PATH)
    longest = max(map(len, scores))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in op2_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == texts.keys() and all(got[k] == brute(texts[k], scores, longest) for k in texts)
