"""Queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import classify, dataset, extract, metrics, query, sink
from sparkloom.plans import generated as gen
from sparkloom.plans.schema import Thresholds
from sparkloom.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def parsed(sources: DataFrame) -> DataFrame:
    """Sources are dealt out to all cores before parsing, which costs far more than moving them."""
    return extract.parse(sources, 4 * sources.sparkSession.sparkContext.defaultParallelism)


def measured(sources: DataFrame) -> DataFrame:
    return metrics.measure(extract.functions(parsed(sources)))


def plain(rows: DataFrame) -> DataFrame:
    """Integers as longs and lists as text, as the SQL has them."""
    cells = {n: F.col(n).cast("long") if t == "int" else F.array_join(n, "|") for n, t in rows.dtypes if t == "int" or t.startswith("array")}
    return rows.withColumns(cells)


NUMBERS = "start_line end_line loc span_loc comment_lines blank_lines cyclo max_nesting nop nolv cond_ops_max cond_nesting num_conditions atfd laa fdp foreign_providers foreign_member_calls foreign_call_providers".split()

#: Customers with their numbers of orders, and the metrics of their functions.
CUSTOMERS = """
WITH f AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS x, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey),
m AS (SELECT k, n, 'src/c' || lpad(CAST(k AS VARCHAR), 9, '0') || '.js' AS relative_path, 'customer_' || k AS function_name, n + 4 AS loc, n + 6 AS span_loc, 1 + (2 + x) * n AS cyclo,
  CASE WHEN n > 0 THEN 1 ELSE 0 END AS max_nesting, CASE WHEN n > 0 THEN 3 + x ELSE 0 END AS cond_ops_max, (3 + x) * n AS atfd,
  CASE WHEN n > 0 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS laa, CASE WHEN n > 0 THEN 1 ELSE 0 END AS fdp FROM f)
"""
LABELLED = (
    CUSTOMERS
    + """, c AS (SELECT *, loc >= 20 AS is_long_method, cyclo >= 21 AS is_complex_method, cond_ops_max >= 4 AS is_complex_conditional, atfd > 30 AND laa < 1.0 / 3 AND fdp <= 30 AS is_feature_envy FROM m),
d AS (SELECT *, is_long_method OR is_complex_method OR is_complex_conditional OR is_feature_envy AS is_smelly, row_number() OVER (ORDER BY relative_path) AS ordinal FROM c),
e AS (SELECT *, 'M-' || CASE WHEN ordinal < 1000000 THEN lpad(CAST(ordinal AS VARCHAR), 6, '0') ELSE CAST(ordinal AS VARCHAR) END AS id FROM d)
"""
)
CHOSEN = Thresholds(long_loc=20, complex_cyclo=21, conditional_ops=4, few=30)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers' dataset, with thresholds that every label meets and misses."""
    once = dataset.deduplicate(measured(gen.customer_sources(spark, sf_dir))).persist(StorageLevel.MEMORY_AND_DISK)  # read for the paths' counts, too
    return classify.classify(dataset.with_ids(once), CHOSEN)


@register(
    """
SELECT 'orders/o' || o_orderkey || '.js' AS relative_path, 'order_' || o_orderkey AS function_name, 'FunctionDeclaration' AS function_type, CAST(1 AS BIGINT) AS start_line, n + 6 AS end_line, n + 4 AS loc,
  n + 6 AS span_loc, CAST(1 AS BIGINT) AS comment_lines, CAST(1 AS BIGINT) AS blank_lines, 1 + 2 * n AS cyclo, CAST(1 AS BIGINT) AS max_nesting, CAST(1 AS BIGINT) AS nop, CAST(1 AS BIGINT) AS nolv,
  CAST(3 AS BIGINT) AS cond_ops_max, CAST(1 AS BIGINT) AS cond_nesting, n AS num_conditions, 3 * n AS atfd, CAST(0 AS DOUBLE) AS laa, CAST(1 AS BIGINT) AS fdp, 'row' AS foreign_providers,
  CAST(0 AS BIGINT) AS foreign_member_calls, '' AS foreign_call_providers
FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""
)
def method_metrics_orders(spark, sf_dir):
    return plain(measured(gen.order_sources(spark, sf_dir)).select("relative_path", "function_name", "function_type", *NUMBERS))


@register(
    """
SELECT 'parts/p' || p_partkey || '.js' AS relative_path, CAST(d AS BIGINT) AS max_nesting, CAST(d AS BIGINT) AS cond_nesting, CAST(1 + d AS BIGINT) AS cyclo, CAST(d AS BIGINT) AS num_conditions, CAST(1 AS BIGINT) AS cond_ops_max
FROM (SELECT p_partkey, p_size % 8 + 1 AS d FROM part)"""
)
def nesting_depth(spark, sf_dir):
    d = F.col("p_size") % 8 + 1
    source = gen.text("function nest(a) {\n", gen.numbered(d, lambda i: gen.text("if (a > ", i, ") {\n")), "a++;\n", gen.times(d, "}\n"), "}\n")
    return plain(measured(gen.part_sources(spark, sf_dir, source)).select("relative_path", "max_nesting", "cond_nesting", "cyclo", "num_conditions", "cond_ops_max"))


@register(
    """
SELECT 'parts/p' || p_partkey || '.js' AS relative_path, CAST(9 + c + e AS BIGINT) AS cyclo, CAST(1 AS BIGINT) AS max_nesting, CAST(4 + e AS BIGINT) AS num_conditions, CAST(1 AS BIGINT) AS cond_nesting
FROM (SELECT p_partkey, p_size % 6 AS c, p_partkey % 4 AS e FROM part)"""
)
def cyclomatic_variants(spark, sf_dir):
    """Every construct once, a switch of some cases, and an else-if chain."""
    c, e = F.col("p_size") % 6, F.col("p_partkey") % 4
    source = gen.text(
        "function every(a, b) {\n  switch (a) {\n",
        gen.numbered(c, lambda i: gen.text("    case ", i, ": break;\n")),
        "    default: b = a ?? b;\n  }\n  for (let i of b) b;\n  for (let i in b) b;\n  for (;;) { break; }\n  while (b) b--;\n  do b++; while (b);\n  try { b(); } catch (x) { b = x; }\n  a ||= 1;\n  if (a) b;",
        gen.numbered(e, lambda i: gen.text(" else if (a == ", i, ") b;")),
        "\n  return a ? b : a;\n}\n",
    )
    return plain(measured(gen.part_sources(spark, sf_dir, source)).select("relative_path", "cyclo", "max_nesting", "num_conditions", "cond_nesting"))


@register(
    """
SELECT 'parts/p' || p_partkey || '.js' AS relative_path, 'outer' AS function_name, CAST(2 * m AS BIGINT) AS cond_ops_max, CAST(1 AS BIGINT) AS num_conditions, CAST(1 + m AS BIGINT) AS cyclo FROM (SELECT p_partkey, p_size % 7 + 1 AS m FROM part)
UNION ALL SELECT 'parts/p' || p_partkey || '.js', 'anonymous@L2:C14', CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(2 AS BIGINT) FROM part"""
)
def condition_ops(spark, sf_dir):
    """A callback inside a test has its own conditions: the test's operators end where it begins."""
    m = F.col("p_size") % 7 + 1
    test = F.array_join(F.transform(F.sequence(F.lit(1), m), lambda i: gen.text("v < ", i)), " && ")
    source = gen.text("function outer(v) {\n  if (v.some((x) => x > 1 ? x : !v) === ", "(", test, ")) return 1;\n}\n")
    return plain(measured(gen.part_sources(spark, sf_dir, source)).select("relative_path", "function_name", "cond_ops_max", "num_conditions", "cyclo"))


@register(
    """
SELECT 'parts/p' || p_partkey || '.js' AS relative_path, CAST(j AS BIGINT) AS atfd, CASE WHEN i + j = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(i AS DOUBLE) / (i + j) END AS laa, CAST(least(j, 2) AS BIGINT) AS fdp,
  CASE WHEN j = 0 THEN '' WHEN j = 1 THEN 'q0' ELSE 'q0|q1' END AS foreign_providers, CAST(j + 1 AS BIGINT) AS foreign_member_calls,
  CASE WHEN j = 0 THEN 'log' WHEN j = 1 THEN 'log|q0' ELSE 'log|q0|q1' END AS foreign_call_providers, 'MethodDefinition' AS function_type
FROM (SELECT p_partkey, p_size % 4 AS i, p_partkey % 5 AS j FROM part)"""
)
def locality(spark, sf_dir):
    """Own and foreign data, calls and their providers; a direct call of an own method counts nowhere."""
    i, j = F.col("p_size") % 4, F.col("p_partkey") % 5
    source = gen.text(
        "class C {\n  m(q0, q1, log) {\n    this.go();\n    log.line();\n", gen.numbered(i, lambda x: gen.text("    this.a", x, " = 1;\n")), gen.numbered(j, lambda x: gen.text("    q", x % 2, ".b.run();\n")), "  }\n}\n"
    )
    return plain(measured(gen.part_sources(spark, sf_dir, source)).select("relative_path", "atfd", "laa", "fdp", "foreign_providers", "foreign_member_calls", "foreign_call_providers", "function_type"))


@register(
    """
SELECT 'parts/p' || p_partkey || '.js' AS relative_path, CAST(6 + a + b AS BIGINT) AS nolv, CAST(3 AS BIGINT) AS nop FROM (SELECT p_partkey, p_size % 5 AS a, p_partkey % 3 AS b FROM part)"""
)
def binding_counts(spark, sf_dir):
    a, b = F.col("p_size") % 5, F.col("p_partkey") % 3
    source = gen.text(
        "function binds({x, y}, [z], w = 1) {\n  let {p, q: [r, , s = 1], ...t} = x;\n  var u;\n  try { y(); } catch ({message}) { z(); }\n",
        gen.numbered(a, lambda i: gen.text("  const a", i, " = ", i, ";\n")),
        gen.numbered(b, lambda i: gen.text("  for (const b", i, " of z) w;\n")),
        "  function inner() { let hidden; }\n}\n",
    )
    rows = measured(gen.part_sources(spark, sf_dir, source)).where("function_name = 'binds'")
    return plain(rows.select("relative_path", "nolv", "nop"))


@register(
    r"""
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT regexp_matches(l, '[^\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]')) AS n_blank
FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS l FROM documents) GROUP BY doc_id"""
)
def line_kinds_documents(spark, sf_dir):
    kinds = gen.table(spark, sf_dir, "documents").select("doc_id", extract.line_kinds(F.col("text"), F.col("text")).alias("k"))
    return kinds.select("doc_id", F.size("k").cast("long").alias("n_lines"), F.size(F.filter("k", lambda k: k == "blank")).cast("long").alias("n_blank"))


@register(
    """
SELECT 'parts/p' || p_partkey || '.js' AS relative_path, CAST(c + b + s + 3 AS BIGINT) AS span_loc, CAST(s + 3 AS BIGINT) AS loc, CAST(c AS BIGINT) AS comment_lines, CAST(b AS BIGINT) AS blank_lines
FROM (SELECT p_partkey, p_size % 5 AS c, p_partkey % 4 AS b, p_size % 3 AS s FROM part)"""
)
def line_counts(spark, sf_dir):
    """Comments, blank lines, and comment marks inside strings, with each kind of line end."""
    c, b, s = F.col("p_size") % 5, F.col("p_partkey") % 4, F.col("p_size") % 3
    source = gen.text("function f() {\n", gen.times(c, "  /* note */ // more\r\n"), gen.times(b, " \t\r"), gen.times(s, "  g('//no /* comment'); // tail\n"), "  g();\n}")
    return plain(measured(gen.part_sources(spark, sf_dir, source)).select("relative_path", "span_loc", "loc", "comment_lines", "blank_lines"))


@register(
    LABELLED
    + "SELECT relative_path, loc >= 31 AS is_long_method, cyclo >= 10 AS is_complex_method, FALSE AS is_complex_conditional, atfd > 3 AS is_feature_envy, concat_ws('|', CASE WHEN loc >= 31 THEN 'Long Method' END, CASE WHEN cyclo >= 10 THEN 'Complex Method' END, CASE WHEN atfd > 3 THEN 'Feature Envy' END) AS smell_types, CAST(CAST(loc >= 31 AS INT) + CAST(cyclo >= 10 AS INT) + CAST(atfd > 3 AS INT) AS BIGINT) AS smell_count, loc >= 31 OR cyclo >= 10 OR atfd > 3 AS is_smelly FROM e"
)
def classify_default(spark, sf_dir):
    rows = classify.classify(measured(gen.customer_sources(spark, sf_dir)))
    return plain(rows.select("relative_path", "is_long_method", "is_complex_method", "is_complex_conditional", "is_feature_envy", "smell_types", "smell_count", "is_smelly"))


@register(LABELLED + "SELECT relative_path, loc >= 12 AND (cyclo >= 21 OR max_nesting >= 5) AS is_long_method FROM e")
def classify_compound(spark, sf_dir):
    limits = Thresholds(long_loc=12, long_compound=True, long_cyclo=21, long_nesting=5)
    return classify.classify(measured(gen.customer_sources(spark, sf_dir)), limits).select("relative_path", "is_long_method")


@register(
    CUSTOMERS
    + ", t(variant, l, c, few) AS (VALUES (0, 31, 10, 3), (1, 10, 6, 1), (2, 14, 30, 100)) SELECT CAST(variant AS BIGINT) AS variant, count(*) AS methods, count(*) FILTER (WHERE loc >= l) AS long_methods, count(*) FILTER (WHERE cyclo >= c) AS complex_methods, count(*) FILTER (WHERE atfd > few AND laa < 1.0 / 3 AND fdp <= few) AS envious FROM m, t GROUP BY variant"
)
def threshold_sweep(spark, sf_dir):
    many = [Thresholds(), Thresholds(long_loc=10, complex_cyclo=6, few=1), Thresholds(long_loc=14, complex_cyclo=30, few=100)]
    rows = classify.sweep(measured(gen.customer_sources(spark, sf_dir)), many)
    return rows.groupBy(F.col("variant").cast("long").alias("variant")).agg(F.count("*").alias("methods"), F.count_if("is_long_method").alias("long_methods"), F.count_if("is_complex_method").alias("complex_methods"), F.count_if("is_feature_envy").alias("envious"))


@register("SELECT 'src/n' || (c_nationkey % 5) || '.js' AS relative_path, min(c_custkey) AS first_seq, CAST(1 AS BIGINT) AS rows_left FROM customer GROUP BY 1")
def dedup_first_wins(spark, sf_dir):
    """Customers of a few nations share a path and a text; the first of each path stays."""
    rows = gen.table(spark, sf_dir, "customer").select("c_custkey", gen.text("src/n", F.col("c_nationkey") % 5, ".js").alias("path"))
    sources = files.from_rows(rows, "path", F.lit("const f = (a) => a;"), seq="c_custkey")
    kept = dataset.deduplicate(measured(sources))
    return kept.groupBy("relative_path").agg(F.min("input_seq").alias("first_seq"), F.count("*").alias("rows_left"))


@register(LABELLED + "SELECT id, ordinal, relative_path, function_name FROM e")
def method_ids(spark, sf_dir):
    return labelled(spark, sf_dir).select("id", F.col("ordinal").cast("long").alias("ordinal"), "relative_path", "function_name")


@register(LABELLED + "SELECT id, function_name FROM e WHERE is_smelly AND is_complex_method AND contains(lower(relative_path || ' ' || function_name), '1.js customer_')")
def filter_status_smell_search(spark, sf_dir):
    return query.select(labelled(spark, sf_dir), "smelly", "complex", " 1.JS Customer_ ").select("id", "function_name")


@register(LABELLED + "SELECT id FROM e WHERE NOT is_smelly")
def filter_clean(spark, sf_dir):
    return query.select(labelled(spark, sf_dir), "clean").select("id")


_FOLDERS = "CASE c_nationkey % 6 WHEN 0 THEN 'dist' WHEN 1 THEN 'Build' WHEN 2 THEN 'builder' WHEN 3 THEN 'node_modules' WHEN 4 THEN 'app' ELSE 'COVERAGE' END"
_KINDS = "CASE c_custkey % 5 WHEN 0 THEN '.js' WHEN 1 THEN '.JSX' WHEN 2 THEN '.ts' WHEN 3 THEN '.mjs' ELSE '.cjs.txt' END"


@register(f"SELECT 'p/' || {_FOLDERS} || '/x' || c_custkey || {_KINDS} AS relative_path FROM customer WHERE c_nationkey % 6 IN (2, 4) AND c_custkey % 5 IN (0, 1, 3)")
def ignored_folders(spark, sf_dir):
    rows = gen.table(spark, sf_dir, "customer").selectExpr(f"concat('p', if(c_custkey % 2 = 0, '/', '\\\\'), {_FOLDERS}, '/x', c_custkey, {_KINDS}) AS path")
    path = F.regexp_replace("path", r"\\", "/")
    return rows.where(files.supported(F.col("path")) & ~files.ignored(F.col("path"))).select(path.alias("relative_path"))


@register(f"SELECT count(*) AS selected, count(*) FILTER (WHERE c_nationkey % 6 IN (2, 4)) AS active, count(*) FILTER (WHERE c_nationkey % 6 NOT IN (2, 4)) AS skipped FROM customer WHERE {_FOLDERS} IS NOT NULL")
def skipped_count(spark, sf_dir):
    rows = gen.table(spark, sf_dir, "customer").selectExpr(f"concat('p/', {_FOLDERS}, '/x', c_custkey, '.js') AS relative_path")
    return files.skipped(rows)


@register("SELECT path AS relative_path, max(c_custkey) AS input_seq FROM (SELECT c_custkey, 'f' || (c_custkey % 40) || '.js' AS path, c_nationkey AS length, c_custkey % 3 AS t FROM customer) GROUP BY path, length, t")
def selection_dedup(spark, sf_dir):
    rows = gen.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("input_seq"), gen.text("f", F.col("c_custkey") % 40, ".js").alias("relative_path"), F.col("c_nationkey").alias("length"), (F.col("c_custkey") % 3).alias("modificationTime"))
    return files.last_selected(rows).select("relative_path", "input_seq")


_STATS = "count(*) AS methods, count(*) FILTER (WHERE is_smelly) AS smelly, count(*) FILTER (WHERE NOT is_smelly) AS clean, count(*) FILTER (WHERE is_long_method) AS long, count(*) FILTER (WHERE is_complex_method) AS complex, count(*) FILTER (WHERE is_complex_conditional) AS conditional, count(*) FILTER (WHERE is_feature_envy) AS envy"


@register(LABELLED + f"SELECT *, methods AS files_analyzed, CAST(0 AS BIGINT) AS failures, printf('%.1f%%', 100.0 * clean / methods) AS clean_pct, printf('%.1f%%', 100.0 * smelly / methods) AS smelly_pct FROM (SELECT {_STATS} FROM e)")
def summary_stats(spark, sf_dir):
    once = parsed(gen.customer_sources(spark, sf_dir)).persist(StorageLevel.MEMORY_AND_DISK)
    return query.summary(classify.classify(metrics.measure(extract.functions(once)), CHOSEN), once)


@register(
    LABELLED
    + f""", s AS (SELECT {_STATS} FROM e), u(place, label, count) AS (SELECT 0, 'Long Method', long FROM s UNION ALL SELECT 1, 'Complex Method', complex FROM s UNION ALL SELECT 2, 'Complex Conditional', conditional FROM s UNION ALL SELECT 3, 'Feature Envy', envy FROM s)
SELECT CAST(place AS BIGINT) AS place, label, count, printf('%.1f%%', 100.0 * count / methods) AS pct FROM u, s"""
)
def smell_distribution(spark, sf_dir):
    rows = classify.classify(measured(gen.customer_sources(spark, sf_dir)), CHOSEN)
    return plain(query.distribution(rows))


@register(LABELLED + "SELECT id, relative_path FROM e ORDER BY ordinal LIMIT 100 OFFSET 100")
def page_slice(spark, sf_dir):
    return query.page(labelled(spark, sf_dir), 2).select("id", "relative_path")


@register(LABELLED + "SELECT greatest(1, CAST(ceil(count(*) / 100.0) AS BIGINT)) AS pages FROM e")
def page_count(spark, sf_dir):
    return query.page_count(classify.classify(measured(gen.customer_sources(spark, sf_dir)), CHOSEN))


@register(LABELLED + "SELECT count(*) FILTER (WHERE is_feature_envy) AS shown, count(*) AS total, format('{:,}', count(*) FILTER (WHERE is_feature_envy)) AS shown_text, format('{:,}', count(*)) AS total_text FROM e")
def shown_of_total(spark, sf_dir):
    return query.shown_of_total(classify.classify(measured(gen.customer_sources(spark, sf_dir)), CHOSEN), smell="envy")


@register(
    LABELLED
    + """SELECT ordinal, id || ',"big, ""co"" x",' || relative_path || ',' || function_name || ',FunctionDeclaration,1,' || span_loc || ',' || loc || ',' || span_loc || ',1,1,' || cyclo || ',' || max_nesting || ',1,1,' || cond_ops_max || ',' || max_nesting || ',' || n || ',' || atfd || ',' ||
  CASE WHEN n > 0 THEN '0.0000' ELSE '1.0000' END || ',' || fdp || ',' || CASE WHEN n > 0 THEN 'row' ELSE '' END || ',0,,' || CAST(is_long_method AS INT) || ',' || CAST(is_complex_method AS INT) || ',' || CAST(is_complex_conditional AS INT) || ',' || CAST(is_feature_envy AS INT) || ',' || CAST(is_smelly AS INT) || ',' ||
  (CAST(is_long_method AS INT) + CAST(is_complex_method AS INT) + CAST(is_complex_conditional AS INT) + CAST(is_feature_envy AS INT)) || ',' || concat_ws('|', CASE WHEN is_long_method THEN 'LongMethod' END, CASE WHEN is_complex_method THEN 'ComplexMethod' END, CASE WHEN is_complex_conditional THEN 'ComplexConditional' END, CASE WHEN is_feature_envy THEN 'FeatureEnvy' END) AS line
FROM e UNION ALL SELECT CAST(0 AS BIGINT), 'ID,PROJECT,FILE,FUNCTION,FUNCTION_TYPE,START_LINE,END_LINE,LOC,SPAN_LOC,COMMENT_LINES,BLANK_LINES,CYCLO,MAXNESTING,NOP,NOLV,CONDOPS_MAX,COND_NESTING,NUM_CONDITIONS,ATFD,LAA,FDP,FOREIGN_PROVIDERS,FOREIGN_MEMBER_CALLS,FOREIGN_CALL_PROVIDERS,is_long_method,is_complex_method,is_complex_conditional,is_feature_envy,is_smelly,SMELL_COUNT,SMELL_TYPES'"""
)
def csv_rows(spark, sf_dir):
    return sink.csv_rows(labelled(spark, sf_dir).withColumn("project", F.lit('big, "co" x')))


@register("SELECT 'parts/p' || p_partkey || '.js' AS file, CASE p_partkey % 3 WHEN 0 THEN 'Unexpected token (2:9)' ELSE 'Identifier ''a'' has already been declared (1:7)' END AS message FROM part WHERE p_partkey % 3 < 2")
def parse_failures(spark, sf_dir):
    """A source that doesn't parse is a failure and leaves the others alone."""
    k = F.col("p_partkey") % 3
    source = F.when(k == 0, "f();\nfunction (").when(k == 1, "let a; let a;").otherwise("return 1; function f() {}")
    return extract.failures(parsed(gen.part_sources(spark, sf_dir, source)))


@register("SELECT 'parts/p' || p_partkey || '.js' AS relative_path, CASE WHEN p_partkey % 2 = 0 THEN 'View' ELSE 'V' || p_size END AS function_name, 'ArrowFunctionExpression' AS function_type, CAST(0 AS BIGINT) AS atfd, CAST(1 AS BIGINT) AS foreign_member_calls, 'items' AS foreign_call_providers FROM part")
def jsx_components(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 2 == 0, "View").otherwise(gen.text("V", F.col("p_size")))
    source = gen.text("const ", name, " = ({items}) => <ul a='1' {...{b: 2}}>text {items.map(i => <li key={i.id}>{/* c */}</li>)}</ul>;")
    rows = measured(gen.part_sources(spark, sf_dir, source)).where("NOT startswith(function_name, 'anonymous')")
    return plain(rows.select("relative_path", "function_name", "function_type", "atfd", "foreign_member_calls", "foreign_call_providers"))


@register("SELECT 'pasted-snippet.js' AS relative_path, 'f' AS function_name, 'javascript-project' AS project, CAST(2 AS BIGINT) AS start_line")
def snippet_source(spark, sf_dir):
    return plain(measured(files.snippet(spark, "\nfunction f() {}\n", "  ")).select("relative_path", "function_name", "project", "start_line"))


@register()
def inline_scripts_pages(spark, sf_dir):
    """Scripts of web pages: how many parse, and their functions."""
    pages = gen.table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(?s)<script>(.*?)</script>"), F.lit(1))).alias("source"))
    sources = files.from_rows(pages, gen.text("page", F.col("page_id"), ".js"), "source", seq="page_id")
    return parsed(sources).select("relative_path", F.col("error").isNull().alias("parses"), F.size("functions").cast("long").alias("functions"))



#: Sources of our own, and by hand: name, type, ATFD, FDP, providers, member calls, their providers, CYCLO of each function.
GOLDEN = [
    ("const o = { get v(){ return 1; }, m(){}, k: () => 2 };", [("v", "FunctionExpression", 0, 0, "", 0, "", 1), ("m", "ObjectMethod", 0, 0, "", 0, "", 1), ("k", "ArrowFunctionExpression", 0, 0, "", 0, "", 1)]),
    (
        'class A { #p(){} static s = () => 1; [k](){} "q-r"(){} }',
        [("p", "MethodDefinition", 0, 0, "", 0, "", 1), ("s", "ArrowFunctionExpression", 0, 0, "", 0, "", 1), ("k", "MethodDefinition", 0, 0, "", 0, "", 1), ("q-r", "MethodDefinition", 0, 0, "", 0, "", 1)],
    ),
    ("a.b = function(){}; export default function(){}", [("b", "FunctionExpression", 0, 0, "", 0, "", 1), ("anonymous@L1:C36", "FunctionDeclaration", 0, 0, "", 0, "", 1)]),
    ("const top = (o) => o?.x.y;", [("top", "ArrowFunctionExpression", 2, 1, "o", 0, "", 1)]),
    ("function f(a){ a?.b?.(); a.c?.d(); }", [("f", "FunctionDeclaration", 1, 1, "a", 2, "a", 1)]),
    ("function f(){ return foo().x + bar.b().c + [1].length; }", [("f", "FunctionDeclaration", 3, 3, "<expression>|bar|foo", 1, "bar", 1)]),
    ("function f(t){ new t.K(); t.g`x`; }", [("f", "FunctionDeclaration", 0, 0, "", 2, "t", 1)]),
    ("function f(s){ return s.repo.save(); }", [("f", "FunctionDeclaration", 1, 1, "s", 1, "s", 1)]),
    ("function f(q, B, a){ B.x; a.x; q.x; foo()().y; this.f().x; }", [("f", "FunctionDeclaration", 4, 4, "a|B|foo|q", 0, "", 1)]),
    ("return 1; function f(a){ return a ? 1 : a > 1 ? 2 : 3; }", [("f", "FunctionDeclaration", 0, 0, "", 0, "", 3)]),
]
_GOLDEN_COLUMNS = "relative_path function_name function_type atfd fdp foreign_providers foreign_member_calls foreign_call_providers cyclo".split()


def _values(rows: list[tuple], columns: list[str]) -> str:
    """SQL for rows of texts, whole numbers and truths."""
    quote = chr(39)
    said = lambda x: str(x).upper() if isinstance(x, bool) else f"CAST({x} AS BIGINT)" if isinstance(x, int) else quote + x.replace(quote, 2 * quote) + quote
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(said, r)) + ')' for r in rows)}) AS t({', '.join(columns)})"


@register(_values([(f"golden/{i:02}.js", *r) for i, (_, rows) in enumerate(GOLDEN) for r in rows], _GOLDEN_COLUMNS))
def golden_cases(spark, sf_dir):
    """Names of members, objects and classes, optional chains, roots that are calls or expressions."""
    rows = spark.createDataFrame([(f"golden/{i:02}.js", s, i) for i, (s, _) in enumerate(GOLDEN)], "path string, source string, seq long")
    return plain(measured(files.from_rows(rows, "path", "source", seq="seq")).select(_GOLDEN_COLUMNS))


#: Halves that are a little less in binary, and one that is exact.
TIES = [(3, 2000, "0.1%"), (19, 2000, "0.9%"), (5, 2000, "0.3%"), (1, 3, "33.3%"), (2, 3, "66.7%"), (7, 7, "100.0%"), (0, 0, "0.0%")]


@register(_values(TIES, ["part", "whole", "pct"]))
def percentage_ties(spark, sf_dir):
    rows = spark.createDataFrame([t[:2] for t in TIES], "part long, whole long")
    return rows.withColumn("pct", query.percentage(F.col("part"), F.col("whole")))


#: Files of a folder and whether a scan of it gives them.
TREE = {"app/Build/x.js": False, "app/builder/x.js": True, "dist/a.js": False, "a.JSX": True, "b.mjs": True, "c.cjs": True, "d.ts": False, "node_modules/m/i.js": False, "lib/deep/er/z.js": True}


def _written(spark: SparkSession) -> str:
    """The address of a new folder that all executors see and that holds the files of ``TREE``."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    root = f"{shared.rstrip('/')}/{uuid.uuid4().hex}/shop"
    for name in TREE:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = path.getFileSystem(conf).create(path)
        out.write(bytearray(f"function in_{name.rpartition('/')[2][0]}(a) {{ return a.b; }}\n".encode()))
        out.close()
    return root


@register(_values([(f"shop/{n}", n.rpartition("/")[2], "shop", f"in_{n.rpartition('/')[2][0]}", 1) for n, kept in TREE.items() if kept], ["relative_path", "file_name", "project", "function_name", "atfd"]))
def folder_scan(spark, sf_dir):
    """A folder with all below it: kinds of files, folders that are left out, the project's name, decoded texts."""
    sources = files.scan(spark, _written(spark), folder=True)
    return plain(measured(sources).select("relative_path", "file_name", "project", "function_name", "atfd"))


@register(_values([("x.js", "javascript-project", "in_x"), ("a.JSX", "javascript-project", "in_a")], ["relative_path", "project", "function_name"]))
def selected_files(spark, sf_dir):
    """Single files go by their names; kinds that aren't supported are left out, a file chosen twice counts once."""
    root = _written(spark)
    return measured(files.scan(spark, [f"{root}/{n}" for n in ("app/builder/x.js", "a.JSX", "d.ts", "a.JSX")])).select("relative_path", "project", "function_name")


_LABEL = "CASE WHEN is_smelly THEN 'SMELLY ' || concat_ws(', ', CASE WHEN is_long_method THEN 'Long Method' END, CASE WHEN is_complex_method THEN 'Complex Method' END, CASE WHEN is_complex_conditional THEN 'Complex Conditional' END, CASE WHEN is_feature_envy THEN 'Feature Envy' END) ELSE 'CLEAN' END"
_SHARED = "CAST(1 AS BIGINT) AS start_line, span_loc AS end_line, loc, cyclo, CAST(max_nesting AS BIGINT) AS max_nesting, CAST(1 AS BIGINT) AS nop, CAST(1 AS BIGINT) AS nolv, CAST(cond_ops_max AS BIGINT) AS cond_ops_max, CAST(max_nesting AS BIGINT) AS cond_nesting, atfd, CASE WHEN n > 0 THEN '0.000' ELSE '1.000' END AS laa, CAST(fdp AS BIGINT) AS fdp"


@register(LABELLED + f"SELECT id, 'javascript-project' AS project, relative_path, function_name, 'FunctionDeclaration' AS function_type, {_SHARED}, CAST(0 AS BIGINT) AS foreign_member_calls, {_LABEL} AS label FROM e")
def dataset_view(spark, sf_dir):
    return plain(query.dataset_view(labelled(spark, sf_dir)))


@register(
    LABELLED
    + f"""SELECT id, function_name, relative_path, {_SHARED}, n AS num_conditions, CASE WHEN n > 0 THEN 'row' ELSE '' END AS providers,
  'function ' || function_name || '(row) {{' || chr(10) || '  // ' || function_name || chr(10) || chr(10) || '  let total = 0;' || chr(10) ||
  repeat('  if (row.qty > ' || (k % 7) || ' && row.disc >= 0' || CASE WHEN k % 4 = 0 THEN ' && row.tax' ELSE '' END || ') {{ total += row.price; }}' || chr(10), n) || '  return total;' || chr(10) || '}}' AS source FROM e"""
)
def segment_view(spark, sf_dir):
    return plain(query.segment_view(labelled(spark, sf_dir)))


#: What a user types for the threshold of long methods, and the threshold after it.
INPUTS = [("12", 12), (" 12px", 12), ("0", 31), ("-4", 31), ("x", 31), ("", 31), ("7.9", 7)]


@register(CUSTOMERS + f", i AS ({_values(INPUTS, ['said', 'long_loc'])}) SELECT said, long_loc, count(*) FILTER (WHERE loc >= long_loc) AS long_methods FROM m, i GROUP BY said, long_loc")
def threshold_inputs(spark, sf_dir):
    """Thresholds from user input, each applied to the same measured rows."""
    limits = [Thresholds().updated("long_loc", said) for said, _ in INPUTS]
    counts = classify.sweep(measured(gen.customer_sources(spark, sf_dir)), limits).groupBy("variant").agg(F.count_if("is_long_method").alias("long_methods"))
    said = spark.createDataFrame([(i, said, t.long_loc) for i, ((said, _), t) in enumerate(zip(INPUTS, limits, strict=True))], "variant int, said string, long_loc long")
    return said.join(counts, "variant").drop("variant")


@register("SELECT CAST(0 AS BIGINT) AS n")
def page_beyond_the_end(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return query.page(rows, 1 << 20).agg(F.count("*").alias("n"))
