import hashlib

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from sparkloom.llm import quality, simhash
from tests.llm.test_decontaminate import brute
from tests.llm.test_lines import brute as brute_lines

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = cp.quality_stage(spark, docs, SF).cache()
    verdict = {r.doc_id: r.predicted for r in quality.classify(docs, labels).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, p in verdict.items() if p} and good.columns == docs.columns
    few = good.limit(60).cache()
    lined = cp.line_stage(spark, few, SF).cache()
    rows = [(r.doc_id, r.text) for r in few.collect()]
    gone = brute_lines(rows)
    want = {}
    for d, t in rows:
        lines = t.split("\n")
        left = [x for i, x in enumerate(lines) if i not in set(gone.get(d, ()))]
        if any(x.strip() for x in left):
            want[d] = "\n".join(left)
    assert {r.doc_id: r.text for r in lined.collect()} == want
    assert all(r.n_chars == len(r.text) for r in lined.collect())
    single = cp.near_duplicate_stage(spark, lined, SF).cache()
    assert {r.doc_id for r in single.collect()} == {r.component_id for r in simhash.near_duplicates(lined).collect()}
    clean = cp.decontamination_stage(spark, single, SF)
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    assert {r.doc_id for r in clean.collect()} == {d for d, _, hit, _ in brute([(r.doc_id, r.text) for r in single.collect()], items) if not hit}
    last = cp.token_stage(spark, clean, SF).collect()
    assert all(len(r.ids) == r.n_tokens for r in last)


def test_run(spark):
    out = cp.run(spark, SF)
    assert 0 < out.count() < 200 and out.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "n_tokens"]


def test_last_stage_decodes(spark):
    docs = spark.createDataFrame([(1, "Hello there, World"), (2, ""), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in cp.token_stage(spark, docs, SF).collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in got.values():
        want = tokenizer.decode(list(r.ids), skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert got[1].text == "Hello there, World" and got[1].n_tokens > 0


def test_stages_on_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, gone string, n_lines int, fp int, root int, doc int, decoded string"
    more = ("en", "s", 1, "g", 1, 2, 3, 4, "d")
    line = "The quick brown fox jumps over the lazy dog near the old river bank, and then it rests."
    rows = [(1, "", *more), (2, None, *more), (None, line, *more), (3, line, *more), (3, line, *more), (4, "word " * 60_000, *more)]
    docs = spark.createDataFrame(rows, schema)
    stages = dict(cp.STAGES)
    lined = stages["line dedup"](spark, docs, SF)
    assert lined.columns == docs.columns
    got = {r.doc_id: r.text for r in lined.collect()}
    assert got == {1: "", 2: None, None: line, 4: rows[-1][1]}  # a null id comes first, and both rows of 3 were only repeats
    single = stages["SimHash near-dedup"](spark, docs, SF)
    assert single.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in single.collect()) == [0, 1, 3, 4]  # 1 and 2 share fingerprint zero, one row of 3 stays
    assert sorted(r.doc_id or 0 for r in stages["benchmark decontamination"](spark, docs, SF).collect()) == [0, 1, 2, 3, 3, 4]
    assert {c.n_tokens for c in stages["BPE encoding and decoding"](spark, docs, SF).collect()} >= {0, 60_000}
    for name in ("line dedup", "SimHash near-dedup", "benchmark decontamination", "quality classifier"):
        out = stages[name](spark, docs.limit(0), SF)
        assert out.count() == 0 and out.columns == docs.columns
