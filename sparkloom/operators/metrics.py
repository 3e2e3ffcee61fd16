"""Metrics of functions: aggregates over the array of facts of each, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _of(kind: str) -> Column:
    return F.filter("facts", lambda x: x["kind"] == kind)


def _most(values: Column) -> Column:
    return F.coalesce(F.array_max(values), F.lit(0))


def sorted_names(names: Column) -> Column:
    """Distinct names in the order of the root collation; equality stays exact."""
    keyed = F.transform(F.array_distinct(names), lambda x: F.struct(F.collate(x, "UNICODE").alias("c"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def measure(functions: DataFrame) -> DataFrame:
    """Adds the metrics and drops the facts."""
    members = functions.withColumns(
        {
            "__data": F.filter("facts", lambda x: (x["kind"] == "member") & ~x["is_call"]),
            "__calls": F.filter("facts", lambda x: (x["kind"] == "member") & x["is_call"] & ~x["local"]),
            "__sites": _of("site"),
        }
    )
    foreign = F.filter("__data", lambda x: ~x["local"])
    rows = members.withColumns(
        {
            "cyclo": 1 + F.size(_of("decision")),
            "max_nesting": _most(F.transform(_of("struct"), lambda x: x["s_depth"])),
            "nolv": F.aggregate(_of("bind"), F.lit(0), lambda n, x: n + x["n"]),
            "cond_ops_max": _most(F.transform("__sites", lambda x: x["n"])),
            "cond_nesting": _most(F.transform("__sites", lambda x: x["c_depth"])),
            "num_conditions": F.size("__sites"),
            "atfd": F.size(foreign),
            "laa": F.when(F.size("__data") == 0, F.lit(1.0)).otherwise((F.size("__data") - F.size(foreign)) / F.size("__data")),
            "foreign_providers": sorted_names(F.transform(foreign, lambda x: x["provider"])),
            "foreign_member_calls": F.size("__calls"),
            "foreign_call_providers": sorted_names(F.transform("__calls", lambda x: x["provider"])),
        }
    )
    return rows.withColumn("fdp", F.size("foreign_providers")).drop("facts", "__data", "__calls", "__sites")
