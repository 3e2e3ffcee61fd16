from datetime import date

from pyspark.sql import functions as F

from sparkloom.llm import pii


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])


def run(spark, texts, **more):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kinds", F.lit("clash"))
    return [r for r in sorted(pii.pseudonymise(rows, **more).collect())]


TEXTS = [
    "mail bosbt.42@mail8.example.com, call +1 (988) 555-2485 or 10.1.2.3; 4387513035237269 on 2024-02-29. ssn 123-45-6789",
    "again 4387513035237269 and Bosbt.42@mail8.example.com",
    "4111 1111 1111 1111, 4111-1111-1111-1111, 2023-02-30, 1.2.3.4.5, 404189497460879, 000-12-3456, 256.1.1.1",
    "",
    None,
    "nothing here",
]


def test_formats_links_and_reversal(spark):
    got = run(spark, TEXTS)
    assert [r.n_values for r in got] == [6, 2, 2, 0, 0, 0]
    assert [r.text for r in got[3:]] == TEXTS[3:]
    words = got[0].text.replace(",", " ").split()
    assert luhn(words[8]) % 10 == 0 and len(words[8]) == 16 and words[8][0] == "4"
    date.fromisoformat(words[10].rstrip("."))
    assert words[8] in got[1].text and words[1] in got[1].text and "4387513035237269" not in got[1].text
    cards = got[2].text.split(", ")
    assert cards[0].replace(" ", "") == cards[1].replace("-", "") and cards[0].count(" ") == 3
    assert cards[2:] == TEXTS[2].split(", ")[2:]
    back = run(spark, [r.text for r in got], reverse=True)
    assert [(r.text or "").lower() for r in back] == [(t or "").lower() for t in TEXTS]
    other = run(spark, TEXTS, key="another")
    assert other[0].text != got[0].text


def test_permutation_is_one_to_one(spark):
    for n in (1, 2, 7, 10, 97, 1000):
        rows = spark.range(n).select(pii.permute(F.col("id"), F.lit(n).cast("long"), "k", F.lit("t")).alias("x")).collect()
        assert sorted(r.x for r in rows) == list(range(n))


def test_clean_texts_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in pii.op6_pii(spark, "/root/testdata/sf0.01").collect()}
    for r in docs.collect():
        if not any(c.isdigit() or c == "@" for c in r.text):
            assert got[r.doc_id].text == r.text and got[r.doc_id].n_values == 0
    assert sum(r.n_values for r in got.values()) > 0


def test_empty_and_long(spark):
    assert pii.pseudonymise(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = run(spark, ["a" * 300000, "9" * 50000, ("x" * 30 + "." + "1" * 20) + "@b.org"])
    assert [r.n_values for r in got] == [0, 0, 1] and got[2].text.endswith("@b.org") and len(got[2].text) == 57


CARDS = [
    ("Visa 4111 1111 1111 1111 12/26", "4111 1111 1111 1111"),
    ("pan 4111111111111111 123.", "4111111111111111"),
    ("row 12 4111111111111111 paid", "4111111111111111"),
    ("12 4111 1111 1111 1111 123 x", "4111 1111 1111 1111"),
    ("7 378282246310005 4 on 2024-02-29", "378282246310005"),
    ("amex 3782 822463 10005 1234", "3782 822463 10005"),
    ("1234 4111-1111-1111-1111 9", "4111-1111-1111-1111"),
    ("odd 41 11 11 11 11 11 11 11 2024", "41 11 11 11 11 11 11 11"),
    ("4111 1111 1111 1111 123-x", "4111 1111 1111 1111"),
    ("4111 1111 1111 1111 123-45-6789", "4111 1111 1111 1111"),
]


def test_cards_next_to_other_digits(spark):
    texts = [t for t, _ in CARDS] + ["two 4111111111111111 5500005555555559 12", "no 4111111111111112 123", "1 " * 3000]
    got = run(spark, texts)
    for r, (text, card) in zip(got, CARDS, strict=False):
        before, after = text.split(card)
        if r.n_values == 1:
            assert r.text.startswith(before) and r.text.endswith(after)
        assert "card" in r.kinds.split(",") and card not in r.text and len(r.text) == len(text)
        assert luhn(r.text[len(before) : len(before) + len(card)]) % 10 == 0
    assert [r.kinds for r in got[:10]] == ["card"] * 4 + ["card,date"] + ["card"] * 4 + ["card,ssn"]
    assert got[10].kinds == "card,card" and got[10].text.endswith(" 12")
    assert [(r.n_values, r.text) for r in got[11:]] == [(0, texts[11]), (0, texts[12])]
    assert [r.text for r in run(spark, [r.text for r in got], reverse=True)] == texts


def test_reversal_where_spans_overlap(spark):
    texts = [f"{1000 + 37 * i} 4111 1111 1111 1111 {i}" for i in range(60)]
    got = run(spark, texts)
    assert all(r.n_values == 1 for r in got)
    assert [r.text for r in run(spark, [r.text for r in got], reverse=True)] == texts


def test_area_codes_below_200(spark):
    texts = ["call +1 (152) 555-8590 now", "call +1 (988) 555-2485 now", "988-555-2485", "152-555-8590", "(152) 555-8590", "+1 (034) 555-1234"]
    got = run(spark, texts)
    assert [r.kinds for r in got] == ["phone", "phone", "phone", "", "", "phone"] and [r.text for r in got[3:5]] == texts[3:5]
    assert got[0].text[9] in "01" and got[5].text != texts[5] and got[0].text != texts[0] and len(got[0].text) == len(texts[0])
    assert "".join(c for c in got[1].text if c.isdigit())[1:] == got[2].text.replace("-", "")
    assert [r.text for r in run(spark, [r.text for r in got], reverse=True)] == texts


def test_scratch_names_keep_apart(spark):
    docs = spark.createDataFrame([(1, "mail alice99@b.org", 5, 6, "k")], "doc_id long, text string, found int, valid int, kinds string")
    out = pii.pseudonymise(docs)
    r = out.first()
    assert (r.found, r.valid, r.n_values, r.kinds) == (5, 6, 1, "email") and "alice99" not in r.text
