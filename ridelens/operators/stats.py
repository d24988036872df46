"""Group statistics joined back onto the fact rows.

All statistics of one call come from a single GROUPING SETS aggregate: one
scan, partial aggregation on every task (a key holding a third of the rows
is pre-aggregated before the shuffle), and a result whose size is bounded by
the key domains. It is joined back without a hint: adaptive execution turns
the join into a broadcast when the measured result is small, and splits a
skewed key when it is not. ``group_stats`` can be
computed once and shared by several operators (means, extremes, label
codes), which then cost no further pass over the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MEAN_NAMES = {"station": "station_avg", "hour": "hour_avg", "line": "line_avg"}


def group_stats(df: DataFrame, keys, value_col: str = "total") -> DataFrame:
    """One row per (grouping key, value): ``_set`` names the key, the key
    column holds the value (the other key columns are null), and ``_avg``,
    ``_max``, ``_min``, ``_n`` summarise ``value_col`` in that group."""
    keys = list(keys)
    v = F.col(value_col)
    exprs = [F.avg(v).alias("_avg"), F.max(v).alias("_max"), F.min(v).alias("_min"), F.count(F.lit(1)).alias("_n")]
    if len(keys) == 1:
        stats = df.groupBy(keys[0]).agg(*exprs).withColumn("_set", F.lit(keys[0]))
    else:
        stats = df.groupingSets([[k] for k in keys], *keys).agg(*exprs, F.grouping_id(*keys).alias("_gid"))
        # grouping_id bit i (from the left) is set when keys[i] is aggregated away
        n = len(keys)
        set_name = None
        for i, k in enumerate(keys):
            cond = F.col("_gid") == ((1 << n) - 1 - (1 << (n - 1 - i)))
            set_name = F.when(cond, F.lit(k)) if set_name is None else set_name.when(cond, F.lit(k))
        stats = stats.withColumn("_set", set_name).drop("_gid")
    return stats


def attach_stats(df: DataFrame, stats: DataFrame, spec: dict[str, dict[str, str]]) -> DataFrame:
    """spec: key -> {output column: 'avg' | 'max' | 'min' | 'n'}; left joins
    each key's slice of the stats table."""
    out = df
    for k, cols in spec.items():
        side = stats.filter(F.col("_set") == k).select(
            k, *[F.col(f"_{kind}").alias(name) for name, kind in cols.items()]
        )
        out = out.join(side, on=k, how="left")
    return out


def with_group_means(df: DataFrame, which=("station", "hour", "line"), total_col: str = "total",
                     stats: DataFrame | None = None) -> DataFrame:
    """Mean total per station, per hour and per line, joined back."""
    keys = list(which)
    stats = group_stats(df, keys, total_col) if stats is None else stats
    return attach_stats(df, stats, {k: {_MEAN_NAMES[k]: "avg"} for k in keys})


def with_station_extremes(df: DataFrame, total_col: str = "total", stats: DataFrame | None = None) -> DataFrame:
    """Max and min total per station, joined back."""
    stats = group_stats(df, ["station"], total_col) if stats is None else stats
    return attach_stats(df, stats, {"station": {"station_max": "max", "station_min": "min"}})


def with_rel_congestion(df: DataFrame, total_col: str = "total") -> DataFrame:
    return df.withColumn("rel_congestion", F.col(total_col) / (F.col("station_avg") + 1))


def with_transfer_by_name(df: DataFrame, line_col: str = "line") -> DataFrame:
    """1 when the line name contains '-' or ','."""
    return df.withColumn("is_transfer", F.coalesce(F.col(line_col).rlike("[-,]"), F.lit(False)).cast("int"))


def station_dim(df: DataFrame) -> DataFrame:
    """Distinct (station, line) with is_transfer = station served by > 1 line."""
    pairs = df.select("station", "line").dropDuplicates(["station", "line"])
    n_lines = pairs.groupBy("station").agg(F.count("line").alias("_n_lines"))
    return (
        pairs.join(n_lines, on="station", how="left")
        .withColumn("is_transfer", F.coalesce(F.col("_n_lines") > 1, F.lit(False)))
        .drop("_n_lines")
    )
