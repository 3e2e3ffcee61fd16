"""From sources to functions with their facts: one pass of the parser in Python workers, then arrays in the JVM.

A source's functions and facts stay nested in its row, so neither lines nor metrics need a join or a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.facts import JS_SPACE, analyse

FACT = "kind string, s_depth int, c_depth int, n int, local boolean, provider string, is_call boolean"
FUNCTION = f"function_name string, function_type string, start_line int, end_line int, start_offset int, end_offset int, nop int, source string, facts array<struct<{FACT.replace(' ', ':').replace(',:', ',')}>>"
RESULT = f"error string, blanked string, functions array<struct<{', '.join(p.replace(' ', ':', 1) for p in FUNCTION.split(', '))}>>"


def _arrow() -> list[pa.DataType]:
    fact = pa.struct([("kind", pa.string()), ("s_depth", pa.int32()), ("c_depth", pa.int32()), ("n", pa.int32()), ("local", pa.bool_()), ("provider", pa.string()), ("is_call", pa.bool_())])
    ints = [(n, pa.int32()) for n in ("start_line", "end_line", "start_offset", "end_offset", "nop")]
    function = pa.struct([("function_name", pa.string()), ("function_type", pa.string()), *ints, ("source", pa.string()), ("facts", pa.list_(fact))])
    return [pa.string(), pa.string(), pa.list_(function)]


def parse(sources: DataFrame, partitions: int | None = None) -> DataFrame:
    """``sources`` with ``error, blanked, functions``; a source that doesn't parse has an error and no functions.

    ``partitions`` deals the sources out first, where few input splits hold many of them.
    """
    names = ["project", "file_name", "relative_path", "source", "input_seq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _arrow()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [analyse(t or "") for t in part.column(3).to_pylist()]
                made = [pa.array([x[k] for x in found], kind) for k, kind in zip(("error", "blanked", "functions"), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*names, "error", "blanked", "functions"])

    rows = sources.select(names)
    rows = rows.repartition(partitions) if partitions else rows
    return rows.mapInArrow(run, f"project string, file_name string, relative_path string, source string, input_seq long, {RESULT}")


def lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\r|\n", -1)


def blank(line: Column) -> Column:
    return ~line.rlike(f"[^{JS_SPACE}]")


def line_kinds(source: Column, blanked: Column) -> Column:
    """code, comment or blank for each line."""
    kind = lambda a, b: F.when(blank(a), "blank").when(blank(F.coalesce(b, F.lit(""))), "comment").otherwise("code")
    return F.zip_with(lines(source), lines(blanked), kind)


def functions(parsed: DataFrame) -> DataFrame:
    """One row a function, with its line counts and facts."""
    kinds = parsed.where("error is null").withColumn("kinds", line_kinds(F.col("source"), F.col("blanked")))
    span = lambda f: F.slice(F.col("kinds"), f["start_line"], F.greatest(F.lit(1), f["end_line"] - f["start_line"] + 1))
    count = lambda f, what: F.size(F.filter(span(f), lambda k: k == what))
    counted = F.transform("functions", lambda f: F.struct(f.alias("f"), count(f, "comment").alias("comment_lines"), count(f, "blank").alias("blank_lines")))
    rows = kinds.select("project", "file_name", "relative_path", "input_seq", F.inline(counted))
    rows = rows.select("project", "file_name", "relative_path", "input_seq", "f.*", "comment_lines", "blank_lines")
    length = F.col("end_line") - F.col("start_line") + 1
    return rows.withColumns({"span_loc": F.greatest(F.lit(1), length), "loc": F.greatest(F.lit(1), length - F.col("comment_lines") - F.col("blank_lines"))})


def failures(parsed: DataFrame) -> DataFrame:
    """``file, message`` of each source that doesn't parse."""
    return parsed.where("error is not null").select(F.col("relative_path").alias("file"), F.col("error").alias("message"))
