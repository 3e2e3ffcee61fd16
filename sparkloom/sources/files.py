"""Sources: files of a folder, single files, a pasted snippet or rows; filters on their paths.

All give ``project, file_name, relative_path, source, input_seq``. Filters act on paths before contents are decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.facts import JS_SPACE, trim
from sparkloom.plans.schema import DEFAULT_PROJECT, IGNORED_FOLDERS, SNIPPET

SUPPORTED = r"(?i)\.(js|mjs|cjs|jsx)$"
COLUMNS = ["project", "file_name", "relative_path", "source", "input_seq"]


def supported(path: Column) -> Column:
    return path.rlike(SUPPORTED)


def ignored(path: Column, folders: tuple[str, ...] = IGNORED_FOLDERS) -> Column:
    """Whether any segment of a relative path is one of ``folders``, whatever its case."""
    if not folders:
        return F.lit(False)
    return F.arrays_overlap(F.split(F.lower(F.regexp_replace(path, r"\\", "/")), "/"), F.array(*map(F.lit, folders)))


def project_name(name: str | None) -> str:
    return trim(name or "") or DEFAULT_PROJECT


def inferred_project(name: str, paths: DataFrame) -> str:
    """The first path's top folder, if the name is still the default and the path has one."""
    first = paths.select("relative_path").first()
    return first[0].split("/")[0] if name == DEFAULT_PROJECT and first and "/" in first[0] else name


def last_selected(files: DataFrame) -> DataFrame:
    """Of files chosen again (same path, size and time) the last, in order of ``input_seq``."""
    same = Window.partitionBy("relative_path", "length", "modificationTime").orderBy(F.col("input_seq").desc())
    return files.withColumn("__n", F.row_number().over(same)).where("__n = 1").drop("__n")


def _decoded(files: DataFrame) -> DataFrame:
    """``content`` as text: UTF-8 without a byte-order mark, bad bytes as U+FFFD."""
    cols = ["project", "file_name", "relative_path", "input_seq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b.decode("utf-8-sig", "replace") for b in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(texts, pa.string())], [*cols, "source"])

    return files.select(*cols, "content").mapInArrow(run, "project string, file_name string, relative_path string, input_seq long, source string").select(COLUMNS)


def scan(spark: SparkSession, paths: str | list[str], folder: bool = False, project: str = DEFAULT_PROJECT, ignore: tuple[str, ...] = IGNORED_FOLDERS) -> DataFrame:
    """Files of supported kinds: a folder with all below it (paths start with its name), or single files (names only)."""
    reader = spark.read.format("binaryFile")
    if folder:
        if not isinstance(paths, str):
            raise ValueError("one folder at a time")
        root = paths.rstrip("/")
        files = reader.option("recursiveFileLookup", "true").load(root)
        base = spark._jvm.org.apache.hadoop.fs.Path(root)
        base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).getParent().toUri().getPath().rstrip("/")
        plain = F.regexp_replace("path", r"^[A-Za-z][\w+.-]*:(//[^/]*)?", "")
        relative = F.substring(plain, F.lit(len(base) + 2), F.length(plain))
    else:
        files = reader.load(paths)
        relative = F.element_at(F.split("path", "/"), -1)
    files = files.withColumn("relative_path", F.regexp_replace(relative, r"\\", "/"))
    files = files.where(supported(F.col("relative_path")) & ~ignored(F.col("relative_path"), ignore))
    name = inferred_project(project, files) if folder else project
    # Ids only break ties among equal paths, so they needn't be consecutive.
    files = files.withColumns({"project": F.lit(project_name(name)), "file_name": F.element_at(F.split("relative_path", "/"), -1), "input_seq": F.monotonically_increasing_id()})
    return _decoded(files if folder else last_selected(files))


def snippet(spark: SparkSession, text: str, project: str = DEFAULT_PROJECT) -> DataFrame:
    """A pasted text as a source; none if it is blank. It bypasses the filters."""
    rows = spark.range(1).select(F.lit(project_name(project)).alias("project"), F.lit(SNIPPET).alias("file_name"), F.lit(SNIPPET).alias("relative_path"), F.lit(text).alias("source"), F.lit(1 << 62).cast("long").alias("input_seq"))
    return rows.where(F.lit(bool(trim(text))))


def from_rows(rows: DataFrame, path: str | Column, source: str | Column, project: str = DEFAULT_PROJECT, seq: str | Column | None = None) -> DataFrame:
    """Sources from any table."""
    path, source = (F.col(x) if isinstance(x, str) else x for x in (path, source))
    seq = F.monotonically_increasing_id() if seq is None else F.col(seq) if isinstance(seq, str) else seq
    return rows.select(F.lit(project_name(project)).alias("project"), F.element_at(F.split(path, "/"), -1).alias("file_name"), path.alias("relative_path"), source.alias("source"), seq.cast("long").alias("input_seq"))


def skipped(files: DataFrame, ignore: tuple[str, ...] = IGNORED_FOLDERS) -> DataFrame:
    """``selected, active, skipped``: how many files the folder filter leaves out."""
    out = ignored(F.col("relative_path"), ignore)
    return files.agg(F.count("*").alias("selected"), F.count_if(~out).alias("active"), F.count_if(out).alias("skipped"))


def trimmed(x: Column) -> Column:
    """A string without the language's white space at both ends."""
    return F.regexp_replace(x, f"^[{JS_SPACE}]+|[{JS_SPACE}]+$", "")
