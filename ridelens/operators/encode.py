"""Encodings and feature selection.

``label_encode`` codes several text columns at once: one pass collects the
distinct (column, value) pairs with map-side de-duplication, a window per
column ranks each column's distinct values (bounded by that column's
domain), and the code table is joined back; adaptive execution picks the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridelens.functions import constants as K
from ridelens.operators.reshape import select_existing

ENCODED_COLUMNS = ("line", "station", "period", "congestion", "month_third")


def with_combos(df: DataFrame) -> DataFrame:
    """hour_dow = 'hour_dow', hour_weekend = 'hour_weekend', line_hour =
    'line_hour'; a null part gives a null combination (coalesced inputs
    must be handled upstream)."""
    s = lambda c: F.col(c).cast("string")
    return (
        df.withColumn("hour_dow", F.concat(s("hour"), F.lit("_"), s("dow")))
        .withColumn("hour_weekend", F.concat(s("hour"), F.lit("_"), s("is_weekend")))
        .withColumn("line_hour", F.concat(s("line"), F.lit("_"), s("hour")))
    )


def _as_text(c: str) -> F.Column:
    # a missing value is encoded as the text 'nan', as the source does
    return F.coalesce(F.col(c).cast("string"), F.lit("nan"))


def label_codes(df: DataFrame, columns=ENCODED_COLUMNS) -> DataFrame:
    """(column_name, value, code): 0-based rank of each distinct value in
    code-point order, per column."""
    columns = [c for c in columns if c in df.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), _as_text(c).alias("value")) for c in columns])
    distinct = df.select(F.inline(pairs)).dropDuplicates(["column_name", "value"])
    w = Window.partitionBy("column_name").orderBy("value")
    return distinct.withColumn("code", (F.row_number().over(w) - 1).cast("int"))


def label_codes_from_stats(stats: DataFrame, columns) -> DataFrame:
    """The code table from a ``group_stats`` table whose grouping keys
    include the columns: its groups are exactly the distinct values."""
    parts = None
    for c in columns:
        part = stats.filter(F.col("_set") == c).select(F.lit(c).alias("column_name"), _as_text(c).alias("value"))
        parts = part if parts is None else parts.unionByName(part)
    w = Window.partitionBy("column_name").orderBy("value")
    return parts.withColumn("code", (F.row_number().over(w) - 1).cast("int"))


def label_encode(df: DataFrame, columns=ENCODED_COLUMNS, suffix: str = "_idx", stats: DataFrame | None = None):
    """Adds ``<column>_idx`` for each listed column that exists; returns
    (encoded DataFrame, code table). With ``stats`` (a ``group_stats`` table
    over these columns) no extra pass over the data is needed."""
    columns = [c for c in columns if c in df.columns]
    if stats is None:
        codes = label_codes(df, columns)
    else:
        codes = label_codes_from_stats(stats, columns)
    out = df
    for c in columns:
        side = codes.filter(F.col("column_name") == c).select(
            F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"{c}{suffix}")
        )
        out = out.join(side, _as_text(c) == F.col(f"_v_{c}"), "left").drop(f"_v_{c}")
    return out, codes


def select_features(df: DataFrame) -> DataFrame:
    """The training table: the listed features that exist, then level,
    use_date, station, line, total."""
    return select_existing(df, K.TRAINING_FEATURES + K.TRAINING_EXTRA)
