"""Views of the dataset: filters, counts and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.sink import fixed
from sparkloom.plans.schema import PAGE, SMELLS
from sparkloom.sources.files import trimmed

STATUS = {"all": None, "clean": "NOT is_smelly", "smelly": "is_smelly"}
SMELL = {"all": None, "long": "is_long_method", "complex": "is_complex_method", "conditional": "is_complex_conditional", "envy": "is_feature_envy"}


def found(query: str) -> Column:
    """Whether path and name, with a space between, contain the trimmed text, whatever its case."""
    said = F.lower(trimmed(F.lit(query)))
    return (said == "") | F.contains(F.lower(F.concat_ws(" ", "relative_path", "function_name")), said)


def chosen(status: str = "all", smell: str = "all", search: str = "") -> Column:
    out = F.lit(True)
    for choice, of in ((status, STATUS), (smell, SMELL)):
        if of[choice]:
            out = out & F.expr(of[choice])
    return out & found(search) if search else out


def select(rows: DataFrame, status: str = "all", smell: str = "all", search: str = "") -> DataFrame:
    return rows.where(chosen(status, smell, search))


def _counts() -> list[Column]:
    names = ["long", "complex", "conditional", "envy"]
    return [F.count("*").alias("methods"), F.count_if("is_smelly").alias("smelly"), F.count_if(~F.col("is_smelly")).alias("clean"), *[F.count_if(c).alias(n) for n, (c, _, _) in zip(names, SMELLS, strict=True)]]


def stats(rows: DataFrame) -> DataFrame:
    return rows.agg(*_counts())


def percentage(part: Column, whole: Column) -> Column:
    """With one decimal, rounded by the exact binary value: 3 of 2,000 are 0.1%, since 0.15 is a little less."""
    return F.concat(fixed(F.coalesce(F.try_divide(part, whole) * 100, F.lit(0.0)), 1), F.lit("%"))


def summary(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """The counts with those of files, and the percentages of clean and smelly methods."""
    files = parsed.agg(F.count_if(F.col("error").isNull()).alias("files_analyzed"), F.count_if(F.col("error").isNotNull()).alias("failures"))
    out = stats(rows).crossJoin(files)  # one row each
    return out.withColumns({"clean_pct": percentage(F.col("clean"), F.col("methods")), "smelly_pct": percentage(F.col("smelly"), F.col("methods"))})


def distribution(rows: DataFrame) -> DataFrame:
    """``place, label, count, pct``: how many methods have each label, in order of the labels."""
    cells = [F.struct(F.lit(i).alias("place"), F.lit(shown).alias("label"), F.col(n).alias("count")) for i, (n, (_, shown, _)) in enumerate(zip(["long", "complex", "conditional", "envy"], SMELLS, strict=True))]
    return stats(rows).select("methods", F.inline(F.array(*cells))).select("place", "label", "count", percentage(F.col("count"), F.col("methods")).alias("pct"))


def shown_of_total(rows: DataFrame, **choice: str) -> DataFrame:
    """``shown, total``, and both with thousands separated."""
    out = rows.agg(F.count_if(chosen(**choice)).alias("shown"), F.count("*").alias("total"))
    return out.withColumns({"shown_text": F.format_number("shown", 0), "total_text": F.format_number("total", 0)})


def page_count(rows: DataFrame, size: int = PAGE) -> DataFrame:
    return rows.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("long").alias("pages"))


def page(rows: DataFrame, number: int = 1, size: int = PAGE) -> DataFrame:
    """The page's rows in order; none beyond the end."""
    return rows.orderBy("ordinal").offset((number - 1) * size).limit(size)


def badge() -> Column:
    return F.when(F.col("is_smelly"), F.concat(F.lit("SMELLY "), F.array_join("smell_types", ", "))).otherwise("CLEAN")


def dataset_view(rows: DataFrame) -> DataFrame:
    columns = "id project relative_path function_name function_type start_line end_line loc cyclo max_nesting nop nolv cond_ops_max cond_nesting atfd".split()
    return rows.select(*columns, fixed(F.col("laa"), 3).alias("laa"), "fdp", "foreign_member_calls", badge().alias("label"))


def segment_view(rows: DataFrame) -> DataFrame:
    columns = "id function_name relative_path start_line end_line loc cyclo max_nesting nop nolv cond_ops_max cond_nesting num_conditions atfd".split()
    return rows.select(*columns, fixed(F.col("laa"), 3).alias("laa"), "fdp", F.array_join("foreign_providers", ", ").alias("providers"), "source")
