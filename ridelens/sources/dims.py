"""Dimension tables built from fixed values (sizes proven by construction:
28 stations, 190 holidays, 11 collector holidays, 4 levels)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelens.functions import constants as K


def literal_table(spark: SparkSession, rows, schema: T.StructType) -> DataFrame:
    """A small table of literal rows planned entirely in the JVM (one
    generator over a one-row range): no Python RDD, no Python worker."""
    structs = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, schema.fields)])
        for row in rows
    ]
    if not structs:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
    return spark.range(1).select(F.inline(F.array(*structs)))


def station_category_dim(spark: SparkSession) -> DataFrame:
    """One row per known station with its six category columns."""
    schema = T.StructType(
        [T.StructField("station", T.StringType(), False)]
        + [T.StructField(c, T.IntegerType(), False) for c in K.STATION_CATEGORY_COLUMNS]
    )
    rows = [(name, *vals) for name, vals in K.STATION_CATEGORIES.items()]
    return literal_table(spark, rows, schema)


def holiday_dates(spark: SparkSession, dates: list[str] | None = None) -> DataFrame:
    """Holiday calendar as one DATE column ``date`` (deduplicated)."""
    dates = K.HOLIDAYS if dates is None else dates
    df = literal_table(spark, [(d,) for d in sorted(set(dates))], T.StructType([T.StructField("d", T.StringType())]))
    return df.select(F.to_date("d").alias("date"))


def holiday_dim(spark: SparkSession) -> DataFrame:
    """The collector's holiday file: (date yyyymmdd text, is_holiday=1, name, holiday_date)."""
    rows = [(d, 1, name) for d, name in K.COLLECTOR_HOLIDAYS_2025]
    schema = T.StructType([T.StructField("date", T.StringType()), T.StructField("is_holiday", T.IntegerType()),
                           T.StructField("holiday_name", T.StringType())])
    df = literal_table(spark, rows, schema)
    return df.withColumn("holiday_date", F.to_date("date", "yyyyMMdd"))


def level_dim(spark: SparkSession) -> DataFrame:
    rows = [(i, lab, K.LEVEL_COLORS[i]) for i, lab in enumerate(K.CONGESTION_LABELS)]
    schema = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("label", T.StringType()),
                           T.StructField("color", T.StringType())])
    return literal_table(spark, rows, schema)
