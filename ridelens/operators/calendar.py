"""Calendar, cyclic and holiday features.

Holiday flags need three membership tests (the date, the day before, the
day after). They are answered by ONE broadcast left join against a small
dimension keyed by date that already carries all three flags, built by
shifting the holiday list; a holiday calendar has at most 366 rows a year,
and the dimension is size-checked before it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.functions import exprs as X


def weekday_columns(date_col: str = "use_date") -> dict:
    dow = F.weekday(date_col).cast("int")
    return {
        "dow": dow,
        "day_name": F.date_format(date_col, "EEEE"),
        "is_weekend": (dow >= 5).cast("int"),
    }


def with_weekday(df: DataFrame, date_col: str = "use_date") -> DataFrame:
    """dow (0 = Monday), English day name, weekend flag (dow >= 5)."""
    return df.withColumns(weekday_columns(date_col))


def with_month_third(df: DataFrame, date_col: str = "use_date") -> DataFrame:
    return df.withColumn("month_third", X.month_third(F.dayofmonth(date_col)))


def with_quarter(df: DataFrame, date_col: str = "use_date") -> DataFrame:
    return df.withColumn("quarter", F.quarter(date_col).cast("int"))


def with_cyclic(df: DataFrame, column: str, period: int, prefix: str | None = None) -> DataFrame:
    p = prefix or column
    return df.withColumn(f"{p}_sin", X.cyclic_sin(column, period)).withColumn(
        f"{p}_cos", X.cyclic_cos(column, period)
    )


def with_time_features(df: DataFrame, date_col: str = "use_date") -> DataFrame:
    """dow, day name, weekend, month third, quarter and the sin/cos pairs of
    hour/24, dow/7 and month/12."""
    cols = weekday_columns(date_col)
    dow = cols["dow"]
    month = F.col("month") if "month" in df.columns else F.month(date_col)
    cols.update({
        "month_third": X.month_third(F.dayofmonth(date_col)),
        "quarter": F.quarter(date_col).cast("int"),
        "hour_sin": X.cyclic_sin("hour", 24), "hour_cos": X.cyclic_cos("hour", 24),
        "dow_sin": X.cyclic_sin(dow, 7), "dow_cos": X.cyclic_cos(dow, 7),
        "month_sin": X.cyclic_sin(month, 12), "month_cos": X.cyclic_cos(month, 12),
    })
    return df.withColumns(cols)


def holiday_flag_dim(holidays: DataFrame, date_col: str = "date") -> DataFrame:
    """date -> (is_holiday, holiday_eve, holiday_next) for every date that
    has at least one flag."""
    h = holidays.select(F.col(date_col).alias("d")).dropDuplicates(["d"])
    parts = (
        h.select(F.col("d").alias("_date"), F.lit(1).alias("h"), F.lit(0).alias("e"), F.lit(0).alias("n"))
        .unionByName(h.select(F.date_sub("d", 1).alias("_date"), F.lit(0).alias("h"), F.lit(1).alias("e"), F.lit(0).alias("n")))
        .unionByName(h.select(F.date_add("d", 1).alias("_date"), F.lit(0).alias("h"), F.lit(0).alias("e"), F.lit(1).alias("n")))
    )
    return parts.groupBy("_date").agg(
        F.max("h").alias("_is_holiday"), F.max("e").alias("_holiday_eve"), F.max("n").alias("_holiday_next")
    )


def with_holiday_flags(df: DataFrame, holidays, date_col: str = "use_date",
                       holiday_date_col: str = "date") -> DataFrame:
    """is_holiday, holiday_eve (next day is a holiday), holiday_next (previous
    day was a holiday) and is_off_day (holiday or weekend; needs is_weekend,
    computed here when absent).

    ``holidays`` is a list of ISO dates (a literal table: its size is known,
    it is broadcast without a check) or a DataFrame with a date column
    (joined without a hint)."""
    if isinstance(holidays, (list, tuple)):
        from ridelens.sources.dims import holiday_dates

        dim = F.broadcast(holiday_flag_dim(holiday_dates(df.sparkSession, list(holidays)), "date"))
    else:
        dim = holiday_flag_dim(holidays, holiday_date_col)
    out = df.join(dim, F.col(date_col) == dim["_date"], "left").drop("_date")
    hol = F.coalesce("_is_holiday", F.lit(0)).cast("int")
    weekend = F.col("is_weekend") if "is_weekend" in df.columns else (F.weekday(date_col) >= 5).cast("int")
    out = out.withColumns({
        "is_holiday": hol,
        "holiday_eve": F.coalesce("_holiday_eve", F.lit(0)).cast("int"),
        "holiday_next": F.coalesce("_holiday_next", F.lit(0)).cast("int"),
        "is_off_day": ((hol == 1) | (weekend == 1)).cast("int"),
    })
    return out.drop("_is_holiday", "_holiday_eve", "_holiday_next")


def with_is_holiday(df: DataFrame, holidays: DataFrame, date_col: str, holiday_date_col: str = "holiday_date",
                    out_col: str = "is_holiday") -> DataFrame:
    """Membership test of a date against a holiday dimension (left join on the
    deduplicated dimension)."""
    dim = holidays.select(F.col(holiday_date_col).alias("_hd")).dropDuplicates(["_hd"])
    dim = dim.withColumn("_hit", F.lit(True))
    out = df.join(dim, F.col(date_col) == dim["_hd"], "left")
    return out.withColumn(out_col, F.coalesce("_hit", F.lit(False))).drop("_hd", "_hit")
