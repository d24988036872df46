"""Profiling: counts, ranges, distributions, rankings.

Every profile is one aggregate (partial on each task, small merge) followed
by a reshape of its one-row result; nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelens.operators.quantiles import quantile_table

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _long_form(wide: DataFrame, names: list[str], prefix: str, value_name: str) -> DataFrame:
    rows = F.array(*[
        F.struct(F.lit(i).alias("col_pos"), F.lit(n).alias("column_name"), F.col(f"{prefix}{i}").alias(value_name))
        for i, n in enumerate(names)
    ])
    return wide.select(F.inline(rows))


def null_counts(df: DataFrame, only_positive: bool = True, limit: int | None = None) -> DataFrame:
    """(col_pos, column_name, null_count) in column order; zero rows dropped."""
    names = df.columns
    wide = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(names)])
    out = _long_form(wide, names, "n", "null_count")
    if only_positive:
        out = out.filter(F.col("null_count") > 0)
    if limit is not None:
        out = out.orderBy("col_pos").limit(limit)
    return out


def duplicate_count(df: DataFrame, keys) -> DataFrame:
    """Rows beyond the first per key (null keys compare equal)."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def value_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("min_value"), F.max(column).alias("max_value"))


def distinct_counts(df: DataFrame, columns) -> DataFrame:
    """Exact distinct non-null values per column, one row."""
    return df.agg(*[F.countDistinct(c).alias(f"n_{c}") for c in columns])


def describe(df: DataFrame, column: str) -> DataFrame:
    """count, mean, sample std, min, exact quartiles (linear interpolation), max."""
    c = F.col(column).cast("double")
    q = quantile_table(df, [column], [0.25, 0.5, 0.75]).scalar()
    out = df.agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    out = out.withColumn("_q", q)
    return out.select("count", "mean", "std", "min", *[F.col("_q")[i].alias(p) for i, p in enumerate(["p25", "p50", "p75"])], "max")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency per value ordered by value; nulls are not counted."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(column)
    )


def period_ranking(df: DataFrame, period_col: str = "period", total_col: str = "total") -> DataFrame:
    return (
        df.groupBy(period_col)
        .agg(F.avg(total_col).alias("mean_total"))
        .orderBy(F.col("mean_total").desc(), F.col(period_col))
    )


def top_stations(df: DataFrame, k: int = 10, total_col: str = "total") -> DataFrame:
    """k stations with the highest mean total (ties by name). The limit is
    the feature: Spark plans it as a per-partition top-k plus a k-row merge."""
    return (
        df.groupBy("station")
        .agg(F.avg(total_col).alias("mean_total"))
        .orderBy(F.col("mean_total").desc(), F.col("station"))
        .limit(k)
    )


def schema_report(df: DataFrame) -> DataFrame:
    """(col_pos, column_name, data_type, non_null) for every column."""
    names = df.columns
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wide = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(names)])
    out = _long_form(wide, names, "n", "non_null")
    tmap = F.create_map(*[x for c in names for x in (F.lit(c), F.lit(types[c]))])
    return out.select("col_pos", "column_name", tmap[F.col("column_name")].alias("data_type"), "non_null")


def head_rows(df: DataFrame, order_cols, n: int = 5) -> DataFrame:
    """The first n rows in a stated order (the source previews its file's first rows; a table has no order of its own)."""
    return df.orderBy(*order_cols).limit(n)


def nonzero_counts(df: DataFrame, columns) -> DataFrame:
    """(col_pos, column_name, nonzero): values != 0, where a missing value
    counts as non-zero (NaN != 0 holds in the source)."""
    wide = df.agg(*[
        F.count_if((F.col(c) != 0) | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(f"n{i}")
        for i, c in enumerate(columns)
    ])
    return _long_form(wide, list(columns), "n", "nonzero")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def inf_counts(df: DataFrame, columns=None) -> DataFrame:
    """(col_pos, column_name, inf_count) over numeric columns."""
    columns = numeric_columns(df) if columns is None else list(columns)
    inf = float("inf")
    wide = df.agg(*[
        F.count_if(F.abs(F.col(c).cast("double")) == inf).alias(f"n{i}") for i, c in enumerate(columns)
    ])
    return _long_form(wide, columns, "n", "inf_count")


def flag_counts(df: DataFrame) -> DataFrame:
    """Records in the morning window, the evening rush, at transfer grade >= 2
    and at business stations."""
    return df.agg(
        F.coalesce(F.sum("f_morning"), F.lit(0)).cast("long").alias("morning_rows"),
        F.coalesce(F.sum("f_evening_rush"), F.lit(0)).cast("long").alias("evening_rows"),
        F.count_if(F.col("cat_transfer") >= 2).alias("transfer2_rows"),
        F.count_if(F.col("cat_business") == 1).alias("business_rows"),
    )


def station_profile(df: DataFrame, station: str) -> DataFrame:
    """One station: rows, transfer grade, group and the level histogram
    (one output row per level present)."""
    found = df.filter(F.col("station") == station).groupBy("station", "level").agg(
        F.count(F.lit(1)).alias("n"), F.max("cat_transfer").alias("_t"), F.max("cat_group").alias("_g"))
    all_levels = Window.partitionBy("station")  # one row per level
    return found.select(
        "station", F.sum("n").over(all_levels).alias("station_rows"), F.max("_t").over(all_levels).alias("cat_transfer"),
        F.max("_g").over(all_levels).alias("cat_group"), "level", "n").orderBy("level")
