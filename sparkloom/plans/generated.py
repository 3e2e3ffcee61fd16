"""JavaScript generated from the driver's tables, with metrics that are known in closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.files import from_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def times(n: Column, part: Column | str) -> Column:
    return F.repeat(F.lit(part) if isinstance(part, str) else part, n.cast("int"))


def numbered(n: Column, make) -> Column:
    """``make(i)`` for i from 0 below n, joined."""
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).cast("int")), make), "")).otherwise("")


def totals(name: Column, n: Column, limit: Column, more: Column | str = "") -> Column:
    """A function of ``n`` tested additions, a comment and a blank line; ``more`` is added to each test."""
    tests = times(n, text("  if (row.qty > ", limit, " && row.disc >= 0", more, ") { total += row.price; }\n"))
    return text("function ", name, "(row) {\n  // ", name, "\n\n  let total = 0;\n", tests, "  return total;\n}\n")


def order_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each order that has line items."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    key = F.col("o_orderkey")
    rows = rows.select(key, text("orders/o", key, ".js").alias("path"), totals(text("order_", key), F.col("n"), F.col("o_custkey") % 50).alias("source"))
    return from_rows(rows, "path", "source", seq="o_orderkey")


def customer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each customer, with a test for each of its orders; tests of every fourth customer have one term more."""
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
    key, n = F.col("c_custkey"), F.coalesce("n", F.lit(0))
    rows = rows.select(key, F.concat(F.lit("src/c"), F.lpad(key.cast("string"), 9, "0"), F.lit(".js")).alias("path"), totals(text("customer_", key), n, key % 7, F.when(key % 4 == 0, " && row.tax").otherwise("")).alias("source"))
    return from_rows(rows, "path", "source", seq="c_custkey")


def part_sources(spark: SparkSession, sf_dir: str, source: Column) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", text("parts/p", F.col("p_partkey"), ".js").alias("path"), source.alias("source"))
    return from_rows(rows, "path", "source", seq="p_partkey")
