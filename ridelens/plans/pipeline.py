"""The source project's stage chains as one lazy DataFrame plan each.

The source runs four processes with CSV files in between; here each stage is
a function DataFrame -> DataFrame and the chain is one plan that Catalyst
optimises end to end (column pruning reaches the parquet scan, group
statistics are joined back, the five history features share one
shuffle). A stage table can still be written between stages with
``ridelens.sources.io.write_stage`` when a job wants a restart point.

Cleaning order matters and follows the source: fill nulls -> labels from
the uncapped total -> trim names -> cap outliers -> group means.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ridelens.operators import calendar, clean, encode, enhance, reshape, stats, windows
from ridelens.session import checkpoint_stage


STATS_KEYS = ["station", "hour", "line", "period", "congestion", "month_third"]


def preprocess_with_stats(long_df: DataFrame, checkpoint: bool = True):
    """(processed table, shared statistics).

    The cleaned table is checkpointed (the source writes its processed CSV
    here); the quartiles read it, and capping, by then a projection with
    constants, is applied as it is read. ONE grouping-sets pass over it then yields every statistic the
    feature chain needs: means per station / hour / line, station extremes
    and the distinct values behind the label codes (capping happens before
    all of them, so computing them together changes no value)."""
    df = clean.fill_missing(long_df)
    df = reshape.with_month_date(df)
    df = reshape.with_period(df)
    df = reshape.with_congestion(df)
    df = reshape.normalize_names(df)
    if checkpoint:
        df = checkpoint_stage(df, "processed")
    df = clean.cap_outliers(df)
    # used by every statistic and code join of the chain: computed once
    shared = checkpoint_stage(stats.group_stats(calendar.with_month_third(df), STATS_KEYS), "stats")
    return stats.with_group_means(df, stats=shared), shared


def preprocess_long(long_df: DataFrame, checkpoint: bool = True) -> DataFrame:
    """Long (use_month, line, station, hour, boardings, alightings, total) ->
    processed table with date, labels, capped counts and group means."""
    return preprocess_with_stats(long_df, checkpoint)[0]


def preprocess(wide_df: DataFrame) -> DataFrame:
    return preprocess_long(reshape.wide_to_long(wide_df))


def engineer_features(processed: DataFrame, holidays, checkpoint: bool = True, shared: DataFrame | None = None):
    """Processed table -> (training feature table, label code table).

    Station extremes and the distinct values behind every label code come
    from one grouping-sets pass over the processed table (``shared``, from
    ``preprocess_with_stats``, when the caller already has it)."""
    df = calendar.with_time_features(processed)
    df = calendar.with_holiday_flags(df, holidays)
    if shared is None:
        shared = stats.group_stats(df, ["station", "line", "period", "congestion", "month_third"])
    df = windows.with_history_features(df)
    df = stats.with_station_extremes(df, stats=shared)
    df = stats.with_rel_congestion(df)
    df = stats.with_transfer_by_name(df)
    df = encode.with_combos(df)
    df, codes = encode.label_encode(df, stats=shared)
    features = encode.select_features(df)
    if checkpoint:
        features = checkpoint_stage(features)
    return features, codes


def enhance_features(features: DataFrame, strict: bool = False) -> DataFrame:
    """Feature table -> categories, hour flags, rush intensity, interactions,
    target-derived columns dropped, nulls and infinities as 0."""
    df = enhance.with_station_categories(features)
    df = enhance.with_hour_flags(df)
    df = enhance.with_rush_intensity(df)
    df = enhance.with_interactions(df)
    df = enhance.drop_target_leaks(df, strict=strict)
    cols = enhance.feature_columns(df)
    df = clean.fill_features(df, cols)
    numeric = [f.name for f in df.schema.fields if f.name in cols and f.dataType.typeName() in ("double", "float")]
    return clean.replace_inf(df, numeric)


def feature_chain(long_df: DataFrame, holidays):
    """Long table -> (feature table, code table) with one statistics pass."""
    processed, shared = preprocess_with_stats(long_df)
    return engineer_features(processed, holidays, shared=shared)


def full_chain(long_df: DataFrame, holidays, strict: bool = False) -> DataFrame:
    features, _ = feature_chain(long_df, holidays)
    return enhance_features(features, strict=strict)
