"""Station categories, hour flags, rush intensity and interaction features.

The 28-station category table is a literal dimension (size known), joined
once with a broadcast hint instead of six per-row dictionary lookups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens import schemas
from ridelens.functions import constants as K
from ridelens.functions import exprs as X
from ridelens.sources.dims import station_category_dim


def with_station_categories(df: DataFrame, dim: DataFrame | None = None, station_col: str = "station") -> DataFrame:
    """Six category columns by station; unknown stations get 0 everywhere.
    The built-in 28-station table is broadcast as is; a caller's table is
    joined without a hint."""
    if dim is None:
        side = F.broadcast(station_category_dim(df.sparkSession).withColumnRenamed("station", "_cat_station"))
    else:
        side = dim.withColumnRenamed("station", "_cat_station")
    out = df.join(side, F.col(station_col) == F.col("_cat_station"), "left").drop("_cat_station")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("int") for c in K.STATION_CATEGORY_COLUMNS})


def with_hour_flags(df: DataFrame, hour_col: str = "hour") -> DataFrame:
    return df.withColumns({name: X.hour_flag(hour_col, name) for name in X.HOUR_FLAGS})


def with_rush_intensity(df: DataFrame, hour_col: str = "hour") -> DataFrame:
    return df.withColumn("rush_intensity", X.rush_intensity(hour_col))


def with_interactions(df: DataFrame) -> DataFrame:
    """Interaction features; the two that need encoded period / station are
    added only when those columns exist."""
    c = F.col
    have = set(df.columns)
    cols = {}
    if {"period_idx", "dow"} <= have:
        cols["time_dow"] = c("period_idx") * 10 + c("dow")
    if {"station_idx", "period_idx"} <= have:
        cols["station_time"] = c("station_idx") * 10 + c("period_idx")
    cols.update({
        "business_rush": c("cat_business") * c("rush_intensity") * 10,
        "transfer_rush": c("cat_transfer") * c("rush_intensity") * 10,
        "university_morning": c("cat_university") * c("f_morning"),
        "business_weekday": c("cat_business") * (1 - c("is_weekend")),
        "commercial_weekend": c("cat_commercial") * c("is_weekend"),
    })
    if "period_idx" in have:
        cols["group_time_dow"] = c("cat_group") * 100 + c("period_idx") * 10 + c("dow")
    cols["transfer_rush_weekday"] = c("cat_transfer") * c("f_morning") * (1 - c("is_weekend"))
    return df.withColumns(cols)


def drop_target_leaks(df: DataFrame, strict: bool = False) -> DataFrame:
    """Drop the target-derived columns the source names. The source's list
    misses rel_congestion (listed under another name), the lags, std_7 and
    line_avg; ``strict=True`` drops those as well."""
    names = list(K.TARGET_RELATED) + (list(K.TARGET_RELATED_STRICT_EXTRA) if strict else [])
    return df.drop(*[n for n in names if n in df.columns])


def feature_columns(df: DataFrame) -> list[str]:
    """All columns except the target, date, index, station and line."""
    return [c for c in df.columns if c not in K.NON_FEATURE_COLUMNS]


# --- feature families: substring tests on the SOURCE names (FIXED VALUES) -----
CATEGORY_MARK = "역_"
INTERACTION_MARK = "interaction"
NEW_FEATURE_MARKS = ["역_", "interaction", "시간대", "강도", "rush", "weekday", "weekend"]


def feature_family(name_col: str = "source_name") -> F.Column:
    """category / interaction / basic, tested on the source name with plain
    substring containment (so the encoded station column, whose source name
    contains the category mark, counts as a category feature)."""
    n = F.col(name_col)
    return (
        F.when(n.contains(CATEGORY_MARK), "category")
        .when(n.contains(INTERACTION_MARK), "interaction")
        .otherwise("basic")
    )


def is_new_feature(name_col: str = "source_name") -> F.Column:
    n = F.col(name_col)
    cond = None
    for m in NEW_FEATURE_MARKS:
        cond = n.contains(m) if cond is None else (cond | n.contains(m))
    return cond


def source_name_column(name_col: str = "column_name") -> F.Column:
    """Map library column names to source names inside Spark (literal map)."""
    m = F.create_map(*[x for k, v in schemas.LIBRARY_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[F.col(name_col)], F.col(name_col))
