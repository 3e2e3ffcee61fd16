import numpy as np
import pytest
import xxhash

from sparkloom.llm import simhash

SCHEMA = "doc_id long, text string, fp string"


def brute(texts: dict[int, str | None]) -> dict[int, tuple[str, int]]:
    prints = {}
    for i, t in texts.items():
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        shingles = [b" ".join(words[j : j + 3]) for j in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0
    name = {i: i for i in texts}
    ids = sorted(texts)
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (prints[i] ^ prints[j]).bit_count() <= 3 and name[i] != name[j]:
                    name[i] = name[j] = min(name[i], name[j])
                    changed = True
    return {i: (f"{prints[i]:016x}", name[i]) for i in ids}


def test_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()} | {9001: None, 9002: " ", 9003: "two words", 9004: "Two\twords", 9005: "é É x"}
    rows = spark.createDataFrame([(i, t, "clash") for i, t in texts.items()], SCHEMA)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(rows).collect()}
    assert got == brute(texts)


@pytest.mark.parametrize("tile", [8, 64, 2048])
def test_links_of_planted_clusters(spark, tile):
    rng = np.random.default_rng(5)
    seeds = rng.integers(1 << 63, size=60)
    fps = {int(s) for s in seeds}
    for s in seeds[:3]:
        for _ in range(150):
            v = int(s)
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                v ^= 1 << int(b)
            fps.add(v)
    fps = np.array(sorted(fps), np.uint64)
    rows = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    edges = [(r.a, r.b) for r in simhash.links(rows, tile=tile).collect()]
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    forest, truth = simhash.Forest(len(fps)), simhash.Forest(len(fps))
    assert all((int(fps[at[a]]) ^ int(fps[at[b]])).bit_count() <= 9 for a, b in edges)
    if edges:
        forest.link(np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges]))
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 3)
    truth.link(i, j)
    assert np.array_equal(forest.root, truth.root)


def test_edge_cases(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(none).count() == 0
    rows = spark.createDataFrame([(1, "a b c d", None), (1, "a b c d", None), (None, "a b c d", None), (2, "x " * 30000, None)], SCHEMA)
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(rows).collect())
    assert got == [(0, 1), (1, 1), (1, 1), (2, 2)]
    kept = simhash.one_of_each(rows).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 2] and kept[0].asDict().keys() == {"doc_id", "text", "fp"}


def test_one_row_of_each_component(spark):
    a, b, c = ("alpha beta gamma delta epsilon", "one two three four five six seven", "red green blue black white grey")
    texts = [(1, a), (5, a), (5, b), (5, b), (6, b), (7, c), (7, a), (7, "completely different words stand here now"), (8, "alone and with its own words"), (None, a), (9, None)]
    rows = spark.createDataFrame([(i, t, str(n)) for n, (i, t) in enumerate(texts)], SCHEMA)
    got = sorted((r.doc_id or 0, r.text, r.fp) for r in simhash.one_of_each(rows).where("text is not null").collect())
    assert got == [(0, a, "9"), (1, a, "0"), (5, b, "2"), (7, texts[7][1], "7"), (7, c, "5"), (8, texts[8][1], "8")]
    assert simhash.one_of_each(rows).count() == 7
