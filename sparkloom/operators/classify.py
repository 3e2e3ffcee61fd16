"""Labels by thresholds: projections only, so that new thresholds never parse again."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.plans.schema import SMELLS, Thresholds


def labels(limit) -> dict[str, Column]:
    """The label columns; ``limit`` gives a threshold's Column by name."""
    large = F.col("loc") >= limit("long_loc")
    tangled = (F.col("cyclo") >= limit("long_cyclo")) | (F.col("max_nesting") >= limit("long_nesting"))
    return {
        "is_long_method": large & (~limit("long_compound") | tangled),
        "is_complex_method": F.col("cyclo") >= limit("complex_cyclo"),
        "is_complex_conditional": F.col("cond_ops_max") >= limit("conditional_ops"),
        "is_feature_envy": (F.col("atfd") > limit("few")) & (F.col("laa") < F.lit(1.0) / F.lit(3.0)) & (F.col("fdp") <= limit("few")),
    }


def _summed(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("smell_types", F.array_compact(F.array(*[F.when(F.col(c), F.lit(shown)) for c, shown, _ in SMELLS])))
    return rows.withColumns({"smell_count": F.size("smell_types"), "is_smelly": F.size("smell_types") > 0})


def classify(metrics: DataFrame, thresholds: Thresholds | None = None) -> DataFrame:
    """Adds labels, ``smell_types``, ``smell_count`` and ``is_smelly``; labels that are there already are replaced."""
    t = thresholds or Thresholds()
    return _summed(metrics.withColumns(labels(lambda name: F.lit(getattr(t, name)))))


def sweep(metrics: DataFrame, many: list[Thresholds]) -> DataFrame:
    """Labels for each of several thresholds, told apart by ``variant``; the metrics are read once."""
    rows = F.array(*[F.struct(F.lit(i).alias("variant"), *[F.lit(getattr(t, f.name)).alias(f"__{f.name}") for f in fields(t)]) for i, t in enumerate(many)])
    out = _summed(metrics.select("*", F.inline(rows)).withColumns(labels(lambda name: F.col(f"__{name}"))))
    return out.drop(*[f"__{f.name}" for f in fields(Thresholds)])
