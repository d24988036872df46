"""Cleaning: null fill, IQR capping, infinity replacement.

``cap_outliers`` takes the exact quartiles of all columns by radix selection
(``quantiles``) and puts them into the row expressions as constants: capping
itself is a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.operators.quantiles import quantiles

COUNT_COLUMNS = ("boardings", "alightings", "total")


def fill_missing(df: DataFrame, columns=COUNT_COLUMNS) -> DataFrame:
    return df.fillna(0, subset=[c for c in columns if c in df.columns])


def fill_features(df: DataFrame, columns) -> DataFrame:
    return df.fillna(0, subset=[c for c in columns if c in df.columns])


def replace_inf(df: DataFrame, columns) -> DataFrame:
    """+/- infinity -> 0 in the listed numeric columns."""
    inf = float("inf")
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({
        c: F.when((F.col(c) == inf) | (F.col(c) == -inf), F.lit(0).cast(types[c])).otherwise(F.col(c))
        for c in columns
    })


def _upper_bounds(df: DataFrame, columns, k: float) -> dict[str, Column]:
    """Per column Q3 + k * (Q3 - Q1) as a constant (null without values)."""
    found = quantiles(df, columns, [0.25, 0.75])
    return {c: F.lit(None if q3 is None else q3 + k * (q3 - q1)).cast("double") for c, (q1, q3) in found.items()}


def cap_outliers(df: DataFrame, columns=COUNT_COLUMNS, k: float = 1.5, mult: float = 2.0) -> DataFrame:
    """Per column, in this order: quartiles of the raw values; clip below at
    0; values above ``mult`` x (Q3 + k*IQR) become Q3 + k*IQR. Columns are
    capped independently (a capped total no longer equals the sum of its
    parts). Output columns are DOUBLE."""
    cols = {}
    for c, ub in _upper_bounds(df, columns, k).items():
        clipped = F.when(F.col(c) < 0, F.lit(0.0)).otherwise(F.col(c).cast("double"))
        cols[c] = F.when(clipped > F.lit(mult) * ub, ub).otherwise(clipped)
    return df.withColumns(cols)


def outlier_counts(df: DataFrame, columns=COUNT_COLUMNS, k: float = 1.5, mult: float = 2.0) -> DataFrame:
    """(column, upper_bound, outlier_count): how many values ``cap_outliers`` replaces."""
    aggs, upper = [], _upper_bounds(df, columns, k)
    for c, ub in upper.items():
        clipped = F.when(F.col(c) < 0, F.lit(0.0)).otherwise(F.col(c).cast("double"))
        aggs.append(F.count_if(clipped > F.lit(mult) * ub).alias(f"n_{c}"))
    wide = df.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(c).alias("column_name"), upper[c].alias("upper_bound"),
                 F.col(f"n_{c}").alias("outlier_count"))
        for c in columns
    ])
    return wide.select(F.inline(rows))
