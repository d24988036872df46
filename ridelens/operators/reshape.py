"""Reshape and projection: wide hour slots to a long table, derived labels.

``wide_to_long`` replaces the source's two melts plus a self merge by one
narrow ``inline`` generator: every wide row emits its 24 (hour, boardings,
alightings) rows in place, so there is no shuffle and no join.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens import schemas
from ridelens.functions import exprs as X

ID_COLUMNS = schemas.WIDE_ID_COLUMNS


def slot_columns(df: DataFrame, mark: str) -> dict[int, str]:
    """Hour -> column for the columns whose name contains ``mark``.

    The hour is read from the label with the pattern ``(\\d+)시-``; a label
    without it raises, listing the offending columns (the source fails too).
    """
    out: dict[int, str] = {}
    bad = []
    for c in df.columns:
        if mark not in c:
            continue
        m = re.search(schemas.SLOT_HOUR_PATTERN, c)
        if m is None:
            bad.append(c)
            continue
        hour = int(m.group(1))
        if hour in out:
            raise ValueError(f"two slot columns for hour {hour}: {out[hour]!r} and {c!r}")
        out[hour] = c
    if bad:
        raise ValueError(f"hour slot labels without an hour: {bad}")
    return out


def unpivot_hours(df: DataFrame, mark: str, value_name: str, ids=ID_COLUMNS) -> DataFrame:
    """Melt the slot columns containing ``mark`` into (ids..., hour, value)."""
    slots = slot_columns(df, mark)
    rows = F.array(*[F.struct(F.lit(h).alias("hour"), F.col(f"`{c}`").alias(value_name)) for h, c in slots.items()])
    return df.select(*ids, F.inline(rows))


def wide_to_long(df: DataFrame, ids=ID_COLUMNS) -> DataFrame:
    """Wide table -> (ids..., hour, boardings, alightings, total), one pass.

    Boarding slots drive the output (a boarding hour without an alighting
    column keeps a null alighting count, as a left join would). total is
    null when either side is null.
    """
    board = slot_columns(df, schemas.BOARDING_MARK)
    alight = slot_columns(df, schemas.ALIGHTING_MARK)
    structs = []
    for h, bcol in board.items():
        acol = alight.get(h)
        a = F.col(f"`{acol}`") if acol is not None else F.lit(None).cast("long")
        structs.append(
            F.struct(F.lit(h).alias("hour"), F.col(f"`{bcol}`").alias("boardings"), a.alias("alightings"))
        )
    out = df.select(*ids, F.inline(F.array(*structs)))
    return out.withColumn("total", F.col("boardings") + F.col("alightings"))


def join_boarding_alighting(boarding: DataFrame, alighting: DataFrame, ids=ID_COLUMNS) -> DataFrame:
    """The two-input form: left equi-join of a boarding long table with an
    alighting long table on (ids, hour). Repeated keys multiply, as in any
    equi-join; the one-pass ``wide_to_long`` is preferred for one wide input.
    """
    keys = list(ids) + ["hour"]
    out = boarding.join(alighting.select(*keys, "alightings"), on=keys, how="left")
    return out.withColumn("total", F.col("boardings") + F.col("alightings"))


def select_existing(df: DataFrame, columns) -> DataFrame:
    """Keep the listed columns that exist, in the listed order."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{c}`") for c in columns if c in have])


def with_month_date(df: DataFrame, month_col: str = "use_month") -> DataFrame:
    """yyyymm -> use_date (first of the month), year, month."""
    m = F.col(month_col)
    d = F.try_to_date(F.concat(m.cast("string"), F.lit("01")), "yyyyMMdd")
    return df.withColumns({"use_date": d, "year": F.year(d), "month": F.month(d)})


def with_period(df: DataFrame, hour_col: str = "hour") -> DataFrame:
    return df.withColumn("period", X.period_label(hour_col))


def with_congestion(df: DataFrame, total_col: str = "total", thresholds=None) -> DataFrame:
    """Absolute congestion label and its level 0..3."""
    kw = {} if thresholds is None else {"thresholds": thresholds}
    label = X.congestion_label(total_col, **kw)
    return df.withColumns({"congestion": label, "level": X.level_of_label(label)})


def normalize_names(df: DataFrame, columns=("line", "station")) -> DataFrame:
    """Strip leading / trailing white space (Unicode, like Python's strip)."""
    return df.withColumns({c: X.strip_unicode(c) for c in columns})
