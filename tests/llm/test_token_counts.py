import random

from sparkloom.llm import token_counts as tc


def greedy(vocabulary: set[bytes], word: bytes) -> int:
    at = n = 0
    while at < len(word):
        for to in range(len(word), at, -1):
            if word[at:to] in vocabulary:
                at, n = to, n + 1
                break
        else:
            return 1
    return n


def test_small_vocabularies_against_greedy():
    rng = random.Random(3)
    for _ in range(300):
        vocabulary = {bytes(rng.choice(b" abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        counter = tc.PieceCounter(sorted(vocabulary))
        for _ in range(20):
            word = bytes(rng.choice(b" abcd") for _ in range(rng.randint(1, 14)))
            assert counter.count(word) == greedy(vocabulary, word), (vocabulary, word)


def test_whole_table_against_greedy(spark):
    vocabulary = set(tc.read_ranks(tc.default_vocabulary()))
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: r for r in tc.op7_token_counts(spark, "/root/testdata/sf0.001").collect()}
    known = {}
    for i, text in docs.items():
        words = text.encode().split()
        assert got[i].n_words == len(words)
        assert got[i].n_tokens == sum(known[w] if w in known else known.setdefault(w, greedy(vocabulary, b" " + w)) for w in words)


def test_edge_cases(spark):
    rows = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "a", 5), (3, "ab " * 100000, 5), (3, "\x00 é", 5)], "doc_id long, text string, n_words int")
    got = sorted((r.doc_id or 0, r.n_words) for r in tc.token_counts(rows).collect())
    assert got == [(0, 1), (1, 0), (2, 0), (3, 2), (3, 100000)]
    assert tc.token_counts(rows.limit(0)).count() == 0
