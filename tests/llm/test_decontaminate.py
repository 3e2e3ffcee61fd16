import hashlib
import re

import duckdb

from sparkloom.llm import decontaminate as dc
from sparkloom.llm.registry import OP10

BENCH = "item_id long, text string, doc string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, x in items:
            v = words(x)
            n = min(10, len(v))
            for s in range(len(v) - n + 1 if v else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit |= set(range(p, p + n))
                        if i is not None:
                            ids.add(str(i))
        out.append((d, len(w), len(hit), ",".join(sorted(ids))))
    return sorted(out, key=str)


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
DOCS = [(1, f"x {ITEM.upper()} y"), (2, ITEM[6:]), (3, "short item, here: short-item here"), (4, None), (5, ""), (None, ITEM), (6, "a a a a a a a a a a a a a"), (7, f"{ITEM} {ITEM}"), (7, f"{ITEM} {ITEM}"), (7, "é"), (8, "epsilon zeta alpha beta gamma delta"), (9, " ".join(["z"] * 60000) + " " + ITEM)]
ITEMS = [(10, ITEM), (9, "short item"), (3, "é"), (2, None), (1, "..."), (None, "x alpha"), (5, "a " * 11), (5, ITEM), (77, "epsilon alpha"), (78, "never seen words at all")]


def test_matches_brute_force(spark):
    docs = spark.createDataFrame([(d, t, "c") for d, t in DOCS], "doc_id long, text string, found string")
    items = spark.createDataFrame([(i, t, "c") for i, t in ITEMS], BENCH)
    got = dc.contamination(docs, items).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in got], key=str) == brute(DOCS, ITEMS)
    kept = dc.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 8]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], BENCH)
    assert [tuple(r) for r in dc.contamination(docs, items).collect()] == [(1, 2, 0, [])]
    assert dc.contamination(docs.limit(0), spark.createDataFrame([(1, "a", "")], BENCH)).count() == 0


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = sorted(tuple(r) for r in dc.op10_decontaminate(spark, sf).collect())
    assert got == sorted(con.execute(OP10).fetchall())
    assert sum(r[5] for r in got) > 0
    assert got[0][4] == hashlib.sha256(b"").hexdigest() or got[0][3] > 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "q beta x alpha gamma q"), (2, "alpha " + "q " * 20 + "beta gamma"), (3, "alpha beta gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "alpha beta gamma", "")], BENCH)
    assert {(r.doc_id, r.item_id) for r in dc.proximity_matches(docs, items, slop=2).collect()} == {(1, 5), (3, 5)}
    assert {r.doc_id for r in dc.proximity_matches(docs, items, slop=0).collect()} == {3}


def test_clean_keeps_columns_whatever_their_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k", 5, "x"), (2, "z", 6, "y"), (None, None, 7, "z")], "doc_id long, text string, __doc int, doc string")
    bench = spark.createDataFrame([(9, "a b c d e f g h i j")], "item_id long, text string")
    out = dc.clean(docs, bench)
    assert out.columns == docs.columns and sorted((r["__doc"], r.doc) for r in out.collect()) == [(6, "y"), (7, "z")]
