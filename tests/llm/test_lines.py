import random

from sparkloom.llm import lines

BASE = "the quick brown fox jumps over the lazy dog while the band plays on and on in the old town square tonight"


def brute(rows):
    """Removed line places of each (doc_id, text), by comparing all lines with all."""
    found = [(d, t, i, lines.normal(x)) for d, t in rows for i, x in enumerate((t or "").split("\n")) if lines.normal(x)]
    sets = [lines.shingles(x[3]) for x in found]
    name = list(range(len(found)))
    for _ in range(len(found)):
        before = list(name)
        for i in range(len(found)):
            for j in range(i):
                if name[i] != name[j] and lines.likeness(sets[i], sets[j]) >= 0.8:
                    name[i] = name[j] = min(name[i], name[j])
        if before == name:
            break
    first = {}
    for k, (d, t, i, _) in enumerate(found):
        first[name[k]] = min(first.get(name[k], (d, t, i)), (d, t, i))
    gone = {}
    for k, (d, t, i, _) in enumerate(found):
        if first[name[k]] != (d, t, i):
            gone.setdefault(d, set()).add(i)
    return {d: sorted(x) for d, x in gone.items()}


def test_matches_brute_force(spark):
    rows = [(1, f"{BASE}\nunique opening line of number one\n\nshort"), (2, f"something else entirely, quite different from the rest\n{BASE.upper()}"), (3, f"  {BASE}x  \nshort\na"), (4, ""), (5, None)]
    rows += [(10 + i, BASE.replace("lazy", f"lazy {i}") + "\n" + f"line {i * 7919} of its own {i * 104729} kind {i * 1299709}") for i in range(40)]
    rows += [(100 + i, BASE[: 60 + i] + "z" * i) for i in range(0, 40, 3)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, line string")
    got = {r.doc_id: sorted(r.gone) for r in lines.repeats(docs.select("doc_id", "text")).collect()}
    assert got == brute(rows)
    kept = {r.doc_id: r.text for r in lines.without_repeats(docs).collect()}
    assert kept[1] == rows[0][1] and kept[5] is None and kept[4] == "" and len(kept) == len(rows)
    assert kept[3] == "a"


def test_tables_that_repeat_or_are_empty(spark):
    schema = "doc_id long, text string"
    assert lines.repeats(spark.createDataFrame([], schema)).count() == 0
    same = spark.createDataFrame([(1, "one line here"), (1, "one line here"), (None, "one line here")], schema)
    got = {r.doc_id: r.text for r in lines.without_repeats(same).collect()}
    assert got == {None: "one line here", 1: ""}


def test_chain_that_the_first_line_does_not_reach(spark):
    steps = [BASE[5 * i :] + "".join(chr(97 + (7 * j * j + 3 * j) % 26) for j in range(5 * i)) for i in range(12)]
    rows = [(i, x) for i, x in enumerate(steps)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: sorted(r.gone) for r in lines.repeats(docs).collect()} == brute(rows)


def test_packed_shingles_agree_with_sets():
    base = "the quick brown fox jumps over the lazy dog near the river bank"
    said = [lines.normal(x) for x in [base, base + "s", base.upper(), base[:40], "naïve — " + base, "漢字かな交じり文の行" * 3, "漢字かな交じり文の行" * 3 + "x", base + " 漢字", "aaaaaaaaa", "abcd", "", "࿿" * 6, "က" * 6]]
    for p in said:
        for q in said:
            expected = lines.likeness(lines.shingles(p), lines.shingles(q)) >= lines.LIKENESS
            assert lines.Said(p).like(lines.Said(q)) == expected, (p, q)


def test_links_between_components_join_them(spark):
    roots = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (8, 8), (9, 8)], "node long, root long")
    joined = lines._joined(roots, spark.createDataFrame([(5, 1), (7, 5), (3, 4)], "a long, b long"))
    assert {tuple(r) for r in joined.collect()} == {(1, 1), (2, 1), (5, 1), (6, 1), (7, 1), (3, 3), (4, 3), (8, 8), (9, 8)}
    assert joined.count() == 9


def test_short_lines_that_share_a_band_are_verified(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    pairs = [(x, x + word(more)) for n, more in ((8, 1), (12, 2), (14, 2)) for x in (word(n) for _ in range(500))]
    keys = lines.bands([x for p in pairs for x in p])[:, : lines.BANDS].reshape(len(pairs), 2, -1)
    pairs = [p for p, k in zip(pairs, keys, strict=True) if (k[0] == k[1]).any()]
    docs = spark.createDataFrame([(2 * i + j, x) for i, p in enumerate(pairs) for j, x in enumerate(p)], "doc_id long, text string")
    assert len(pairs) > 1450
    assert {r.doc_id for r in lines.repeats(docs).collect()} == {2 * i + 1 for i in range(len(pairs))}


def all_pairs(rows):
    """Removed line places of each (doc_id, text), from the exact likeness of all pairs of lines whose sizes allow a link."""
    found = [(d, t, i, lines.normal(x)) for d, t in rows for i, x in enumerate((t or "").split("\n")) if lines.normal(x)]
    said = sorted({x[3] for x in found})
    sets = {x: lines.shingles(x) for x in said}
    order = sorted(said, key=lambda x: len(sets[x]))
    name = {x: x for x in said}

    def top(x):
        while name[x] != x:
            x = name[x]
        return x

    n_links = 0
    for i, x in enumerate(order):
        for y in order[i + 1 :]:
            if len(sets[x]) < 0.8 * len(sets[y]):
                break
            if lines.likeness(sets[x], sets[y]) >= 0.8:
                n_links += 1
                a, b = sorted((top(x), top(y)))
                name[b] = a
    first = {}
    for d, t, i, x in found:
        first[top(x)] = min(first.get(top(x), (d, t, i)), (d, t, i))
    gone = {}
    for d, t, i, x in found:
        if first[top(x)] != (d, t, i):
            gone.setdefault(d, set()).add(i)
    return {d: sorted(x) for d, x in gone.items()}, n_links


def test_recall_against_all_pairs_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want, n_links = all_pairs([tuple(r) for r in docs.collect()])
    got = {r.doc_id: sorted(r.gone) for r in lines.repeats(docs).collect()}
    assert n_links > 30 and sum(map(len, want.values())) > 300
    assert got == want  # recall 1.0, short lines included


def test_tiles_and_further_bands_link_as_one_tile_does(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    words = [word() for _ in range(24)]
    rows = [(i, " ".join(word() if rng.random() < 0.08 else w for w in words)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    buckets = lines.keep(lines._buckets(docs), "buckets")
    roots = spark.createDataFrame([], "node long, root long")
    table = lines.line_table(docs)
    texts = lines.keep(lines._texts(docs, table.dropDuplicates(["h"])), "texts")

    def joined(**how):
        edges = lines._rest(buckets, roots, texts, **how)
        return {r.node: r.root for r in lines.components(edges).collect()}

    whole = joined()
    assert len(whole) > 40 and joined(tile=16, split=100) == whole
    further = joined(tile=8, split=2)  # bands of bands may lose a link of 0.8 now and then
    assert len(set(further) & set(whole)) > 0.95 * len(whole)


def test_stars_of_stars_hold_all_lines(monkeypatch):
    monkeypatch.setattr(lines, "STAR", 4)
    key, h = lines.np.repeat(lines.np.uint64(5), 30), lines.np.arange(30, dtype=lines.np.uint64)
    keys, first, k, lead, x = lines._stars(lines.np.concatenate([key, key[:1]]), lines.np.concatenate([h, h[:1]]), 5)
    assert keys.tolist() == [5] and first.tolist() == [0] and sorted(x.tolist()) == list(range(1, 30))
    assert {a: b for a, b in zip(x.tolist(), lead.tolist(), strict=True)} == {i: i // 4 * 4 if i % 4 else 0 for i in range(1, 30)}
    assert [len(c) for c in lines._stars(key[:5], h[:5], 5)] == [5, 5, 0, 0, 0]
    assert sorted(zip(*(c.tolist() for c in lines._pairs(key[:3], h[:3])), strict=True)) == [(5, 0, 1), (5, 0, 2), (5, 1, 2)]
