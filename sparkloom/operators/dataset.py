"""The dataset: duplicates out, total order, ordinals and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["relative_path", "function_type", "start_offset", "end_offset", "function_name"]


def deduplicate(rows: DataFrame) -> DataFrame:
    """The first row, by ``input_seq``, of each path, type, range and name."""
    first = Window.partitionBy(*KEY).orderBy("input_seq")
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def with_ids(rows: DataFrame) -> DataFrame:
    """Adds ``ordinal`` (from 1) and ``id`` in the total order: path, offsets, lines, name; names and paths collated.

    Rows are numbered within their path. Only the table of paths with their counts is summed up in one task.
    """
    # Paths that collate alike but differ are told apart by their bytes, here as in the order of paths.
    paths = rows.groupBy("relative_path").agg(F.count("*").alias("__n"))
    ordered = Window.orderBy(F.collate("relative_path", "UNICODE"), "relative_path")
    before = F.sum("__n").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")
    paths = paths.select(F.col("relative_path").alias("__path"), before.alias("__before"))
    own = Window.partitionBy("relative_path").orderBy("start_offset", "end_offset", "start_line", "end_line", F.collate("function_name", "UNICODE"), "input_seq")
    out = rows.withColumn("__row", F.row_number().over(own)).join(paths, F.col("relative_path") == F.col("__path"))
    out = out.withColumn("ordinal", F.col("__before") + F.col("__row")).drop("__path", "__before", "__row")
    return out.withColumn("id", F.format_string("M-%06d", "ordinal"))
