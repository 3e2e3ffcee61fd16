import hashlib

from pyspark.sql import functions as F

from sparkloom.llm import merkle

SCHEMA = "doc_id long, text string, root string"


def edited(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (d, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        new = t[: len(t) - q] + after[:q]
        out.append((d, len(t), hashlib.sha256(new.encode()).hexdigest()))
    return sorted(out, key=str)


def test_edits_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id * 3 - 500, r.text) for r in docs.collect()] + [(None, "null id é"), (10**12, None), (10**12 + 1, ""), (7, "b twice"), (7, "a twice")]
    table = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)
    got = merkle.compare_with_edits(table).collect()
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=str) == edited(rows)
    long = [r for r in got if r.n_chars > 500]
    assert min(r.near_edited for r in long) > 0.5 and sum(r.near_next < 0.05 for r in long) > 0.9 * len(long)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by_text = {}
    text = dict(rows)
    for r in got:
        if r.doc_id != 7:
            by_text.setdefault(text[r.doc_id] or "", set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values()) and len(set().union(*by_text.values())) == len(by_text)


def test_small_tables(spark):
    assert merkle.compare_with_edits(spark.createDataFrame([], SCHEMA)).count() == 0
    one = merkle.compare_with_edits(spark.createDataFrame([(5, "abcdefgh", None)], SCHEMA)).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1


def test_edits_are_located(spark):
    a = "one two three\nfour five six\n" + " ".join(f"w{i}" for i in range(24))
    b = a.replace("five", "FIVE").replace("w17", "W17") + "\nnew"
    row = spark.createDataFrame([(a, b)], "a string, b string").select(merkle.edits(merkle.short(merkle.leaves(F.col("a"))), merkle.short(merkle.leaves(F.col("b")))).alias("e")).first()
    assert [tuple(x) for x in row.e] == [(1, 0), (2, 2), (3, None)]
