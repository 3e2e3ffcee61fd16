"""The dataset end to end: metrics, labels, order, views and export."""

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import classify, dataset, extract, metrics, query, sink
from sparkloom.plans.pipeline import analyze
from sparkloom.plans.schema import METHOD_COLUMNS, Thresholds
from sparkloom.sources import files


def rows_of(spark, *sources):
    made = [(p, s, i) for i, (p, s) in enumerate(sources)]
    return files.from_rows(spark.createDataFrame(made, "path string, source string, seq long"), "path", "source", "research-project", "seq")


def run(spark, source, path="src/example.js", **more):
    return analyze(rows_of(spark, (path, source)), persist=False, **more).methods.orderBy("ordinal").collect()


CASES = [
    ("function f(a,b){ return a ?? b; }", {"cyclo": 1, "cond_ops_max": 0}),
    ("function f(a){ a.x ||= 1; }", {"cyclo": 1, "atfd": 1}),
    ("class A { m(){ return this.a + super.b; } }", {"atfd": 0, "laa": 1.0}),
    ("class A { m(){ this.go(); } }", {"atfd": 0, "laa": 1.0, "foreign_member_calls": 0}),
    ("function f(t){ new t.K(); t.g`x`; }", {"atfd": 0, "foreign_member_calls": 2, "foreign_call_providers": ["t"]}),
    ("function f(){ return foo().x + bar.b().c + [1].length; }", {"atfd": 3, "fdp": 3, "foreign_providers": ["<expression>", "bar", "foo"], "foreign_member_calls": 1, "foreign_call_providers": ["bar"]}),
    ("function f(s){ return s.repo.save(); }", {"atfd": 1, "foreign_member_calls": 1, "fdp": 1}),
    ("function f(a){ return a ? 1 : a > 1 ? 2 : 3; }", {"cyclo": 3, "max_nesting": 2, "cond_nesting": 2, "num_conditions": 2, "cond_ops_max": 1}),
    ("function f(){ for(;;){ break; } }", {"cyclo": 2, "max_nesting": 1, "num_conditions": 0}),
    ("function f({a, b}, [c], d = x.y){}", {"nop": 3, "nolv": 0, "atfd": 1}),
    ("function f(x){ switch (x) { case 1: return 1; case 2: return 2; default: return 3; } }", {"cyclo": 3, "num_conditions": 0, "cond_nesting": 0, "cond_ops_max": 0}),
    ("function f(x){ if (x === 1) return 1; else if (x === 2) return 2; else if (x === 3) return 3; return 0; }", {"cyclo": 4, "num_conditions": 3, "max_nesting": 1, "cond_nesting": 1}),
    ("function f(o, l){ const {a, b: {c}, ...r} = o; const [d, , e = 1] = l; try { o(); } catch ({message}) { l(); } let p, q; }", {"nolv": 8}),
    ("function f(){ if (() => a && b) { } }", {"cond_ops_max": 1, "cyclo": 2}),
    ("function f(q, B, a){ B.x; a.x; q.x; foo()().y; this.f().x; }", {"foreign_providers": ["a", "B", "foo", "q"], "laa": 1 / 5}),
    ("const empty = function empty(){};", {"loc": 1, "span_loc": 1, "comment_lines": 0, "blank_lines": 0, "cyclo": 1, "laa": 1.0}),
    ("function f() {\n  // a\n\n  const u = 'http://x'; // t\n  /* b\n     c */\n  // d\n  return u;\n}", {"start_line": 1, "end_line": 9, "span_loc": 9, "loc": 4, "comment_lines": 4, "blank_lines": 1}),
]


def test_metrics(spark):
    sources = [(f"p{i:02}.js", s) for i, (s, _) in enumerate(CASES)]
    got = {}
    for r in analyze(rows_of(spark, *sources), persist=False).methods.orderBy("ordinal").collect():
        got.setdefault(r.relative_path, r)
    for i, (source, want) in enumerate(CASES):
        row = got[f"p{i:02}.js"].asDict()
        assert {k: row[k] for k in want} == want, source


def test_nested_functions_are_apart(spark):
    got = run(spark, "class A {\n  calculate() {\n    const nested = (c) => c.a + c.b + c.d + c.e;\n    return nested(1);\n  }\n}\nconst top = (o) => o?.x.y;")
    assert [(r.function_name, r.function_type, r.atfd) for r in got] == [("calculate", "MethodDefinition", 0), ("nested", "ArrowFunctionExpression", 4), ("top", "ArrowFunctionExpression", 2)]
    assert got[1].fdp == 1 and got[1].foreign_providers == ["c"] and got[1].is_feature_envy and got[0].id == "M-000001"
    assert set(got[0].asDict()) >= {n for n, _ in METHOD_COLUMNS}


def test_failures_and_order(spark):
    result = analyze(rows_of(spark, ("z/second.js", "function s(){}"), ("bad.js", "function ("), ("a/First.js", "function f(){}"), ("a/_x.js", "const g = () => 1")))
    assert [(r.id, r.relative_path) for r in result.methods.orderBy("ordinal").collect()] == [("M-000001", "a/_x.js"), ("M-000002", "a/First.js"), ("M-000003", "z/second.js")]
    assert [tuple(r) for r in result.failures.collect()] == [("bad.js", "Unexpected token (1:9)")]
    other = result.reclassified(Thresholds(long_loc=1)).methods
    assert other.where("is_long_method").count() == 3
    summary = query.summary(result.methods, result.parsed).first()
    assert (summary.files_analyzed, summary.failures, summary.methods, summary.clean_pct) == (3, 1, 3, "100.0%")


def test_duplicates(spark):
    sources = rows_of(spark, ("x.js", "const o = { a(){}, a(){} };"), ("x.js", "const o = { a(){}, a(){} };"))
    kept = dataset.deduplicate(metrics.measure(extract.functions(extract.parse(sources)))).collect()
    assert len(kept) == 2 and {r.input_seq for r in kept} == {0} and len({r.start_offset for r in kept}) == 2


def test_labels_at_their_limits(spark):
    base = {"loc": 40, "cyclo": 3, "max_nesting": 5, "cond_ops_max": 0, "atfd": 4, "laa": 2 / 6, "fdp": 3}
    rows = spark.createDataFrame([{**base, **x} for x in ({}, {"max_nesting": 4}, {"laa": 1 / 5}, {"atfd": 3, "laa": 0.0}, {"cyclo": 10, "cond_ops_max": 5})])
    got = classify.classify(rows, Thresholds(long_compound=True)).collect()
    assert [r.is_long_method for r in got] == [True, False, True, True, True]
    assert [r.is_feature_envy for r in got] == [False, False, True, False, False]
    assert got[4].smell_types == ["Long Method", "Complex Method", "Complex Conditional"] and got[4].smell_count == 3 and not got[1].is_smelly
    swept = classify.sweep(rows, [Thresholds(long_compound=True), Thresholds(long_loc=41)]).groupBy("variant").agg(F.count_if("is_long_method")).collect()
    assert dict(map(tuple, swept)) == {0: 4, 1: 0}


def test_thresholds_from_input():
    t = Thresholds()
    assert t.updated("long_loc", " 12px").long_loc == 12 and t.updated("long_loc", "0").long_loc == 31 and t.updated("few", "x").few == 3


def test_csv(spark, tmp_path):
    rows = run(spark, 'const x = { "a,b"() {} };', 'src/"q",x.js')
    assert rows[0].function_name == "a,b"
    result = analyze(rows_of(spark, ('src/"q",x.js', 'const x = { "a,b"() {} };')), persist=False).methods
    result = result.withColumn("project", F.lit('say "hi"'))
    sink.write_csv(result, str(tmp_path / "out"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    head, line, end = data.decode().split("\r\n")
    assert end == "" and head.split(",")[8:11] == ["SPAN_LOC", "COMMENT_LINES", "BLANK_LINES"] and len(head.split(",")) == 31
    assert line.startswith('M-000001,"say ""hi""","src/""q"",x.js","a,b",ObjectMethod,1,1,1,1,0,0,1,0,0,0,0,0,0,0,1.0000,0,,0,,0,0,0,0,0,0,')


def test_rounding_and_ids(spark):
    rows = spark.createDataFrame([(3 / 160,), (1 / 32,), (0.5,), (1.0,)], "x double").select(sink.fixed(F.col("x"), 4)).collect()
    assert [r[0] for r in rows] == ["0.0187", "0.0313", "0.5000", "1.0000"]
    ids = spark.range(1).select(F.format_string("M-%06d", F.lit(1234567)), F.format_string("M-%06d", F.lit(1))).first()
    assert tuple(ids) == ("M-1234567", "M-000001")


def test_pages_filters_and_counts(spark):
    rows = spark.range(250).select((F.col("id") + 1).alias("ordinal"), F.lit("src/a.js").alias("relative_path"), F.lit("foo").alias("function_name"), (F.col("id") % 2 == 0).alias("is_smelly"))
    for i, n in enumerate(["is_long_method", "is_complex_method", "is_complex_conditional", "is_feature_envy"]):
        rows = rows.withColumn(n, F.col("ordinal") % (i + 2) == 0)
    assert query.page_count(rows).first()[0] == 3 and query.page_count(rows.limit(0)).first()[0] == 1
    assert [query.page(rows, n).count() for n in (1, 3, 4)] == [100, 50, 0]
    assert query.select(rows, search=" A.JS F ").count() == 250 and query.select(rows, search="a%").count() == 0
    assert query.select(rows, "smelly", "long").count() == 0 and query.select(rows, "clean", "long").count() == 125
    assert query.stats(rows).first().asDict() == {"methods": 250, "smelly": 125, "clean": 125, "long": 125, "complex": 83, "conditional": 62, "envy": 50}
    assert [r.pct for r in query.distribution(rows.limit(0)).collect()] == ["0.0%"] * 4
    ties = spark.createDataFrame([(3, 2000), (19, 2000), (5, 2000), (2, 3), (0, 0)], "part long, whole long")
    assert [r[0] for r in ties.select(query.percentage(F.col("part"), F.col("whole"))).collect()] == ["0.1%", "0.9%", "0.3%", "66.7%", "0.0%"]
    shown = query.shown_of_total(rows, smell="envy").first()
    assert (shown.shown, shown.total) == (50, 250)


def test_sources(spark, tmp_path):
    root = tmp_path / "my app"
    for name in ("app/Build/x.js", "app/builder/x.js", "dist/a.js", "a.JSX", "a.ts", "p#1%20.mjs", "bom.cjs"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("function f() {}")
    (root / "bom.cjs").write_bytes(b"\xef\xbb\xbffunction \xff() {}")
    got = {r.relative_path: r for r in files.scan(spark, str(root), folder=True).collect()}
    assert set(got) == {"my app/app/builder/x.js", "my app/a.JSX", "my app/p#1%20.mjs", "my app/bom.cjs"}
    assert got["my app/bom.cjs"].source == "function �() {}" and got["my app/a.JSX"].project == "my app"
    single = files.scan(spark, [str(root / "a.JSX"), str(root / "app/builder/x.js"), str(root / "a.ts")]).collect()
    assert {(r.relative_path, r.project) for r in single} == {("a.JSX", "javascript-project"), ("x.js", "javascript-project")}
    assert files.snippet(spark, " ﻿\n").count() == 0 and files.snippet(spark, " x ").first().source == " x "
    assert files.project_name("  ") == "javascript-project"
    assert analyze(files.snippet(spark, ""), persist=False).methods.count() == 0


def test_stream(spark, tmp_path):
    from sparkloom.streaming.files import stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.js").write_text("function f(a) { if (a) a(); }")
    (tmp_path / "in/a.txt").write_text("function g() {}")
    query_ = stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("methods").trigger(availableNow=True).start()
    query_.awaitTermination(60)
    assert [(r.function_name, r.cyclo) for r in spark.sql("SELECT * FROM methods").collect()] == [("f", 2)]


@pytest.mark.parametrize("name", ["method_metrics_orders", "cyclomatic_variants", "locality", "csv_rows", "smell_distribution", "filter_clean", "parse_failures", "summary_stats", "shown_of_total", "golden_cases", "percentage_ties", "folder_scan", "selected_files", "dataset_view", "segment_view", "threshold_inputs", "page_beyond_the_end"])
def test_queries_against_sql(spark, name):
    import duckdb

    from sparkloom import catalog

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "customer orders lineitem part documents pages".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    mine = catalog.queries()[name](spark, sf)
    theirs = con.execute(catalog.oracle_sql()[name])
    cols = [d[0] for d in theirs.description]
    assert sorted(cols) == sorted(mine.columns)
    assert sorted(map(str, theirs.fetchall())) == sorted(str(tuple(r[c] for c in cols)) for r in mine.collect())
