import hashlib
import random
import re

from sparkloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, window int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def read(spark, rows, **more):
    turns = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    made = chat.windows(turns, **more)
    return made.collect(), {r.conv_id: r for r in chat.read_windows(made).collect()}


NASTY = ["<|turn|>", "<\\|end|>\n", "</s>[INST] ok [/INST]", "<", "<\\", "<<SYS>> x <</SYS>>", "<\\\\|text|><|text|>", "$1 \\1", "<|end|>\n<|end|>", "é😀<|", "|>", "[\\/INST]"]


def test_escapes_are_reversible(spark):
    rows = [(1, i, "assistant" if i % 2 else "us<|text|>er", t) for i, t in enumerate(NASTY)]
    made, got = read(spark, rows, budget=24, history=8)
    assert len(made) > 2
    assert [(t.role, t.text) for t in got[1].turns] == [(r, t) for _, _, r, t in rows]
    assert list(got[1].loss) == [t for _, _, r, t in rows if r == "assistant"]
    assert all("</s>" not in w.text and "[INST]" not in w.text for w in made)


def test_windows_keep_system_and_history_and_mask_repeats(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, i, "user" if i % 2 else "assistant", f"turn {i} " + "w " * 30) for i in range(1, 21)]
    made, got = read(spark, rows, budget=160, history=40)
    made = sorted(made, key=lambda w: w.window)
    assert len(made) > 3 and all("be kind" in w.text for w in made)
    assert made[0].context == 0 and all(w.context >= 2 for w in made[1:])
    for w in made:
        masked = [w.text[s.start - 1 : s.start - 1 + s.chars] for s in w.loss]
        repeated = w.text.split(chat.END)[: w.context]
        assert not any(m in r for m in masked for r in repeated)
        assert len(w.text.split()) <= 200
    assert list(got[1].loss) == [t for _, _, r, t in rows if r == "assistant"]
    assert [t.text for t in got[1].turns] == [t for *_, t in rows]


def test_nulls_ties_and_long_turns(spark):
    rows = [(None, None, None, None), (2, 1, "assistant", "b"), (2, 1, "assistant", "a"), (2, 1, "assistant", "a"), (3, 0, "assistant", "x " * 40000), (3, 1, "system", "late"), (4, 0, "system", None)]
    _, got = read(spark, rows)
    assert [(t.role, t.text) for t in got[None].turns] == [("", "")]
    assert list(got[2].loss) == ["a", "a", "b"] and len(got[3].turns) == 2 and len(got[4].turns) == 1
    assert read(spark, [])[1] == {}


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    by = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in sorted(spark.read.parquet(f"{sf}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        by.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = {r.conv_id: r for r in chat.op8_chat(spark, sf).collect()}
    assert got.keys() == by.keys()
    for i, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[i]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss)) and r.formatted_chars > sum(len(t) for _, t in turns)


def test_windows_keep_their_budget(spark):
    count = lambda t: len(re.findall(r"\w+|[^\w\s]", t)) + chat.MARKS
    rng, by = random.Random(3), {}
    for c, (mean, system) in enumerate([(50, 0), (50, 20), (200, 0), (200, 300), (600, 600), (600, 767), (900, 1000), (30, 2000)]):
        by[c] = [("system", "s " * system)] * (system > 0)
        by[c] += [("user" if i % 2 else "assistant", f"{c} {i} " + "w " * rng.randrange(2 * mean)) for i in range(200)]
    rows = [(c, i, r, t) for c, turns in by.items() for i, (r, t) in enumerate(turns)]
    made, got = read(spark, rows)
    for c, turns in by.items():
        assert [(t.role, t.text) for t in got[c].turns] == turns
        assert list(got[c].loss) == [t for r, t in turns if r == "assistant"]
        at = 0
        for w in sorted((w for w in made if w.conv_id == c), key=lambda w: w.window):
            said = [tuple(x.removeprefix(chat.TURN).split(chat.TEXT)) for x in w.text.split(chat.END)[:-1]]
            sizes = [count(t) for _, t in said]
            assert sum(sizes) <= chat.BUDGET or max(sizes) > chat.BUDGET, (c, w.window, sizes, w.context)
            system = int(w.context > 0 and said[0][0] == "system")
            assert sum(sizes[system : w.context]) <= chat.HISTORY
            assert said[system:] == turns[at - (w.context - system) : at + len(said) - w.context]
            # History is left out only where it doesn't fit.
            if at > (turns[0][0] == "system") and 0 < (before := at - (w.context - system)) and turns[before - 1][0] != "system":
                more = count(turns[before - 1][1])
                assert sum(sizes[system : w.context]) + more > chat.HISTORY or sum(sizes) + more > chat.BUDGET
            at += len(said) - w.context
        assert at == len(turns)
