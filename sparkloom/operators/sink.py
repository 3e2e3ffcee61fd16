"""Export as CSV text, byte for byte: 31 columns, CRLF after every line, quotes only where needed."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.plans.schema import METHOD_COLUMNS, SMELLS

HEADER = [h for _, h in METHOD_COLUMNS if h]


def fixed(x: Column, places: int) -> Column:
    """A double with so many decimals, by its exact binary value, halves away from zero. No built-in rounds like this."""
    unit = Decimal(1).scaleb(-places)

    @F.pandas_udf("string")
    def rounded(v: pd.Series) -> pd.Series:
        known = {x: str(Decimal(x).quantize(unit, ROUND_HALF_UP)) for x in v.unique()}
        return v.map(known)

    return rounded(x)


def escaped(x: Column) -> Column:
    return F.when(x.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def cell(name: str, kind: str) -> Column:
    c = F.col(name)
    if name == "smell_types":
        names = F.create_map(*[F.lit(x) for _, shown, exported in SMELLS for x in (shown, exported)])
        return F.array_join(F.transform(c, lambda x: F.coalesce(names[x], x)), "|")
    if kind == "boolean":
        return c.cast("int").cast("string")
    return F.array_join(c, "|") if kind.startswith("array") else fixed(c, 4) if name == "laa" else c.cast("string")


def csv_rows(rows: DataFrame) -> DataFrame:
    """``ordinal, line``: the export's lines without their ends; the header is ordinal 0."""
    kinds = dict(rows.dtypes)
    line = F.concat_ws(",", *[escaped(cell(n, kinds[n])) for n, h in METHOD_COLUMNS if h])
    head = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("ordinal"), F.lit(",".join(HEADER)).alias("line"))
    return head.union(rows.select(F.col("ordinal").cast("long").alias("ordinal"), line.alias("line")))


def write_csv(rows: DataFrame, path: str) -> None:
    """Text files of the lines in order: joined by their names' order, they are the file that a download gives.

    The lines are dealt out by ranges of their ordinal, so each task sorts and writes its share.
    """
    csv_rows(rows).orderBy("ordinal").select("line").write.option("lineSep", "\r\n").text(path)
