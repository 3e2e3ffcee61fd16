import random
import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkloom.llm import bpe

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
MODEL = bpe.WordBpe(bpe.default_vocabulary())
HARD = ["", "  ", "<|endoftext|> a <|startoftext|>b", "ΑΣ ΟΔΟΣ İstanbul ǅ ﬁ \x1c x\x85y   z", "é é ñ 한국어 日本語 😀😀 don't I'LL 123 a\x00b", "A" * 5000, "''s hello world's'", "<|ENDOFTEXT|>"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aehinorst AEs'.,<|>endoftx"), st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"])), max_size=40))
def test_any_text(text):
    assert MODEL.encode([text])[0] == LIBRARY.encode(text, add_special_tokens=False).ids


def test_hard_texts():
    assert MODEL.encode(HARD) == [x.ids for x in LIBRARY.encode_batch(HARD, add_special_tokens=False)]
    assert MODEL.proposed and MODEL.merged


def test_checks_agree_with_merging():
    words = sorted({w for t in HARD for w in MODEL.split(t) if isinstance(w, str)})
    for w in words:
        assert MODEL.known[w] == MODEL.ids[MODEL.merge(MODEL.symbols(w))].tolist()


def test_query_matches_the_library(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in bpe.op9_bpe(spark, sf).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for d, e in zip(docs, LIBRARY.encode_batch([d.text for d in docs], add_special_tokens=False), strict=True):
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(e.ids), sha(" ".join(map(str, e.ids))))
        assert r.decoded_sha256 == sha(LIBRARY.decode(e.ids, skip_special_tokens=False))


def test_edge_cases(spark):
    rows = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (None, "a b", "c"), (3, "ab " * 100000, "c"), (3, "<|endoftext|>", "c")], "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(rows)).collect()
    assert sorted((r.doc_id or 0, len(r.ids), r.decoded[:13]) for r in out) == [(0, 2, "a</w> b</w>"), (1, 0, ""), (2, 0, ""), (3, 1, "<|endoftext|>"), (3, 100000, "ab</w> ab</w>")]
    both = bpe.encode(rows, decoded="both")
    assert sorted((r.doc_id or 0, r.text or "", r.both) for r in both.collect()) == sorted((r.doc_id or 0, r.text or "", r.decoded) for r in out) and both.columns == [*rows.columns, "both"]
    assert bpe.encode(rows.limit(0), decoded="both").count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [320])], "doc_id long, ids array<int>")
    assert bpe.decode(nulls).first().decoded == ""


def test_long_words_without_order():
    rng = random.Random(3)
    for chars in ("abcdefghijklmnopqrstuvwxyzé", "ab", "aaaaaaaaab漢字"):
        word = "".join(rng.choices(chars, k=20_000))
        assert MODEL.encode([word])[0] == LIBRARY.encode(word, add_special_tokens=False).ids
