"""A stream of source files: metrics of each new file's functions. An addition; ids need a whole dataset, so there are none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.classify import classify
from sparkloom.operators.extract import functions, parse
from sparkloom.operators.metrics import measure
from sparkloom.plans.schema import DEFAULT_PROJECT, IGNORED_FOLDERS, Thresholds
from sparkloom.sources.files import ignored, supported


def stream(spark: SparkSession, folder: str, thresholds: Thresholds | None = None, project: str = DEFAULT_PROJECT) -> DataFrame:
    """Labelled metrics of the functions in text files that appear in ``folder``; write it in append mode."""
    files = spark.readStream.format("text").option("wholetext", "true").load(folder).select("value", F.col("_metadata.file_name").alias("name"))
    files = files.where(supported(F.col("name")) & ~ignored(F.col("name"), IGNORED_FOLDERS))
    rows = files.select(F.lit(project).alias("project"), F.col("name").alias("file_name"), F.col("name").alias("relative_path"), F.col("value").alias("source"), F.lit(0).cast("long").alias("input_seq"))
    return classify(measure(functions(parse(rows))), thresholds)
