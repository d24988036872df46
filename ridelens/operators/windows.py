"""Lag and rolling features over (station, hour) histories.

All five features share one window specification, so Spark plans them as
one shuffle on (station, hour) and one sort. The fact table at this point is
at most one row per (date, line, station, hour): a window group holds one
station-hour's history (dates x lines), which is bounded by the calendar and
the line count, not by the raw data volume - even when one station carries
a third of all raw rows, that skew was removed by the aggregation that built
the table.

Rows are ordered by (use_date, line): the source orders by date and hour
only, leaving same-date rows of different lines in arbitrary order; the line
makes the order total and deterministic. Shifts count rows, not days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PARTITION = ("station", "hour")
ORDER = ("use_date", "line")


def history_window(partition=PARTITION, order=ORDER):
    return Window.partitionBy(*partition).orderBy(*order)


def with_lags(df: DataFrame, lags=(1, 7), value_col: str = "total", partition=PARTITION, order=ORDER,
              fill: float | None = 0) -> DataFrame:
    w = history_window(partition, order)
    cols = {}
    for k in lags:
        c = F.lag(value_col, k).over(w).cast("double")
        cols[f"lag_{k}"] = F.coalesce(c, F.lit(float(fill))) if fill is not None else c
    return df.withColumns(cols)


def with_rolling(df: DataFrame, value_col: str = "total", partition=PARTITION, order=ORDER,
                 fill: float | None = 0) -> DataFrame:
    """ma_3, ma_7: means over the current and previous 2 / 6 rows (fewer at
    the start); std_7: sample standard deviation over the same 7 rows (null
    for a single row, then filled)."""
    w = history_window(partition, order)
    v = F.col(value_col).cast("double")
    feats = {
        "ma_3": F.avg(v).over(w.rowsBetween(-2, 0)),
        "ma_7": F.avg(v).over(w.rowsBetween(-6, 0)),
        "std_7": F.stddev_samp(v).over(w.rowsBetween(-6, 0)),
    }
    return df.withColumns({
        name: (F.coalesce(c, F.lit(float(fill))) if fill is not None else c) for name, c in feats.items()
    })


def with_history_features(df: DataFrame, value_col: str = "total") -> DataFrame:
    return with_rolling(with_lags(df, value_col=value_col), value_col=value_col)
