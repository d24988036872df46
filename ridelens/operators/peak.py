"""Peak-relative congestion: each hour's total as a share of the busiest
hour of the same (station, line, month).

The peak is a window maximum over (station, line, use_month): at most 24
rows per group, so the window never holds more than a day's hours no matter
how large the table is; all stations are handled in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridelens.functions import exprs as X
from ridelens.sources.payloads import hourly_arrays

PEAK_PARTITION = ("station", "line", "use_month")


def hourly_totals(df: DataFrame, on_col: str = "boardings", off_col: str = "alightings") -> DataFrame:
    """ride_on / ride_off (missing = 0) and their sum; hours with no riders are dropped."""
    on = F.coalesce(F.col(on_col).cast("double"), F.lit(0.0))
    off = F.coalesce(F.col(off_col).cast("double"), F.lit(0.0))
    out = df.withColumns({"ride_on": on, "ride_off": off, "passengers_total": on + off})
    return out.filter(F.col("passengers_total") > 0)


def with_peak(df: DataFrame, partition=PEAK_PARTITION) -> DataFrame:
    """max_passengers, congestion_percent (1 decimal), level (from the
    unrounded share: >= 90, >= 70, >= 40), is_peak (ties all true), counts
    truncated to integers."""
    w = Window.partitionBy(*partition)
    share = F.col("passengers_total") / F.col("_peak") * 100
    return (
        df.withColumn("_peak", F.max("passengers_total").over(w))
        .withColumns({
            "congestion_percent": F.round(share, 1),
            "peak_level": X.peak_level(share),
            "is_peak": F.col("passengers_total") == F.col("_peak"),
            "max_passengers": F.col("_peak").cast("long"),
            "passengers": F.col("passengers_total").cast("long"),
            "ride_on": F.col("ride_on").cast("long"),
            "ride_off": F.col("ride_off").cast("long"),
        })
        .drop("_peak")
    )


RESPONSE_COLUMNS = ["event_id", "hour", "passengers", "max_passengers", "congestion_percent", "peak_level", "is_peak"]


def response_peaks(df: DataFrame, payload_col: str = "payload") -> DataFrame:
    """The single-response report of every landed response: its hour totals, its peak and each hour's share. All 24
    hours of a response sit in its row, so the peak is the maximum of an array: no shuffle, also on a stream."""
    rows = hourly_arrays(df, payload_col)
    total = lambda x: x["ride_on"] + x["ride_off"]
    rows = rows.withColumn("_peak", F.array_max(F.transform("hours", total)))
    rows = rows.select("event_id", "_peak", F.inline("hours")).withColumn("_t", F.col("ride_on") + F.col("ride_off")).filter("_t > 0")
    share = F.col("_t") / F.col("_peak") * 100
    return rows.select("event_id", "hour", F.col("_t").cast("long").alias("passengers"), F.col("_peak").cast("long").alias("max_passengers"),
                       F.round(share, 1).alias("congestion_percent"), X.peak_level(share).alias("peak_level"),
                       (F.col("_t") == F.col("_peak")).alias("is_peak"))


def normalize_hour(hour) -> int:
    """8, '8' and '08' all mean hour 8."""
    return int(str(hour).strip())


def at_hour(df: DataFrame, hour, hour_col: str = "hour") -> DataFrame:
    return df.filter(F.col(hour_col) == F.lit(normalize_hour(hour)))


def with_bar(df: DataFrame, pct_col: str = "congestion_percent") -> DataFrame:
    """One block per full 5 % of the rounded share; order the report by hour."""
    return df.withColumn("bar", F.repeat(F.lit("█"), (F.col(pct_col) / 5).cast("int")))
