"""Registered queries: one per operator of the inventory, each reading the
driver's tables (through the fixture views) and returning a DataFrame whose
column names match the SQL oracle in ``ridelens.plans.oracle``.

Floating results that two engines may compute with different rounding
(transcendental functions, standard deviations) are rounded to 6 decimals.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelens.operators import calendar, clean, encode, enhance, lookup, peak, profile, reshape, score, stats, windows
from ridelens.operators import model as M
from ridelens.operators import partials
from ridelens.plans import monthly, pipeline
from ridelens.operators import forest as FN
from ridelens.session import scratch_path as _scratch
from ridelens.session import checkpoint_stage
from ridelens.sources import dims, io, payloads, versions
from ridelens.sources import fixtures as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

KEYS = ["use_date", "line", "station", "hour"]
MONTH_KEYS = ["use_month", "line", "station", "hour"]


def query(fn):
    QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --- phase 1 ------------------------------------------------------------------
@query
def q_top_stations(spark, d):
    return profile.top_stations(V.v_clean(spark, d), k=10).select("station", r6("mean_total").alias("mean_total"))


# --- phase 2: reshape and cleaning ------------------------------------------------
def _long(spark, d):
    return reshape.wide_to_long(V.v_wide(spark, d))


@query
def q_wide_to_long(spark, d):
    return _long(spark, d).select(*MONTH_KEYS, "boardings", "alightings", "total")


@query
def q_long_from_two_inputs(spark, d):
    w = V.v_wide(spark, d)
    b = reshape.unpivot_hours(w, "승차인원", "boardings")
    a = reshape.unpivot_hours(w, "하차인원", "alightings")
    return reshape.join_boarding_alighting(b, a).select(*MONTH_KEYS, "boardings", "alightings", "total")


@query
def q_month_date(spark, d):
    return reshape.with_month_date(_long(spark, d)).select(*MONTH_KEYS, "use_date", "year", "month")


@query
def q_period(spark, d):
    return reshape.with_period(V.v_clean(spark, d)).select(*KEYS, "period")


@query
def q_congestion_level(spark, d):
    return reshape.with_congestion(V.v_clean(spark, d)).select(*KEYS, "total", "congestion", "level")


@query
def q_normalize_names(spark, d):
    return reshape.normalize_names(V.v_dirty(spark, d)).select(*KEYS, "total")


@query
def q_fill_missing(spark, d):
    r = V.v_ridership(spark, d).withColumn("total", F.col("boardings") + F.col("alightings"))
    return clean.fill_missing(r).select(*KEYS, "boardings", "alightings", "total")


@query
def q_cap_outliers(spark, d):
    return clean.cap_outliers(reshape.normalize_names(V.v_dirty(spark, d))).select(*KEYS, "boardings", "alightings", "total")


@query
def q_outlier_counts(spark, d):
    return clean.outlier_counts(V.v_dirty(spark, d)).select(
        "column_name", r6("upper_bound").alias("upper_bound"), "outlier_count"
    )


def _growth(spark, d):
    # 2^total overflows to +infinity above total = 1023: a derived column with infinities
    return V.v_clean(spark, d).withColumn("growth", F.pow(F.lit(2.0), F.col("total").cast("double")))


@query
def q_replace_inf(spark, d):
    return clean.replace_inf(_growth(spark, d), ["growth"]).select(*KEYS, "total", "growth")


# --- phase 3: profiling ---------------------------------------------------------------
@query
def q_null_counts(spark, d):
    return profile.null_counts(V.v_wide(spark, d), only_positive=True)


@query
def q_duplicate_count(spark, d):
    return profile.duplicate_count(V.v_ridership(spark, d), ["use_month", "line", "station"])


@query
def q_value_range(spark, d):
    return profile.value_range(V.v_monthly(spark, d), "use_month")


@query
def q_distinct_counts(spark, d):
    return profile.distinct_counts(V.v_clean(spark, d), ["line", "station", "hour"])


@query
def q_describe_total(spark, d):
    out = profile.describe(V.v_clean(spark, d), "total")
    return out.select("count", *[r6(c).alias(c) for c in ["mean", "std", "min", "p25", "p50", "p75", "max"]])


@query
def q_level_counts(spark, d):
    return profile.value_counts(reshape.with_congestion(V.v_clean(spark, d)), "level")


@query
def q_period_ranking(spark, d):
    out = profile.period_ranking(reshape.with_period(V.v_clean(spark, d)))
    return out.select("period", r6("mean_total").alias("mean_total"))


@query
def q_inf_counts(spark, d):
    return profile.inf_counts(_growth(spark, d), ["boardings", "alightings", "total", "growth"])


# --- phase 4: group statistics and calendar ----------------------------------------------
@query
def q_group_means(spark, d):
    out = stats.with_group_means(V.v_clean(spark, d))
    return out.select(*KEYS, "total", *[r6(c).alias(c) for c in ["station_avg", "hour_avg", "line_avg"]])


@query
def q_station_extremes(spark, d):
    return stats.with_station_extremes(V.v_clean(spark, d)).select(*KEYS, "total", "station_max", "station_min")


@query
def q_rel_congestion(spark, d):
    out = stats.with_rel_congestion(stats.with_group_means(V.v_clean(spark, d), which=("station",)))
    return out.select(*KEYS, r6("rel_congestion").alias("rel_congestion"))


@query
def q_transfer_by_name(spark, d):
    return stats.with_transfer_by_name(V.v_clean(spark, d)).select(*KEYS, "is_transfer")


@query
def q_station_dim(spark, d):
    return _station_dim(spark, d)


@query
def q_weekday_features(spark, d):
    return calendar.with_weekday(V.v_daily_orders(spark, d)).select("use_date", "n_orders", "dow", "day_name", "is_weekend")


@query
def q_month_third(spark, d):
    return calendar.with_month_third(V.v_daily_orders(spark, d)).select("use_date", "month_third")


@query
def q_quarter(spark, d):
    return calendar.with_quarter(V.v_daily_orders(spark, d)).select("use_date", "quarter")


def _monthly_dated(spark, d):
    return reshape.with_month_date(V.v_monthly(spark, d))


@query
def q_cyclic(spark, d):
    out = calendar.with_time_features(_monthly_dated(spark, d))
    cols = ["hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos"]
    return out.select(*MONTH_KEYS, *[r6(c).alias(c) for c in cols])


@query
def q_holiday_flags(spark, d):
    days = calendar.with_weekday(V.v_daily_orders(spark, d))
    out = calendar.with_holiday_flags(days, V.fixture_holiday_dates())
    return out.select("use_date", "is_holiday", "holiday_eve", "holiday_next", "is_off_day")


# --- phase 5: history windows, encodings, enhanced features -----------------------------------
@query
def q_lags(spark, d):
    out = windows.with_lags(_monthly_dated(spark, d))
    return out.select(*MONTH_KEYS, "total", "lag_1", "lag_7")


@query
def q_rolling(spark, d):
    out = windows.with_rolling(_monthly_dated(spark, d))
    return out.select(*MONTH_KEYS, "total", *[r6(c).alias(c) for c in ["ma_3", "ma_7", "std_7"]])


@query
def q_combos(spark, d):
    out = encode.with_combos(calendar.with_weekday(_monthly_dated(spark, d)))
    return out.select(*MONTH_KEYS, "hour_dow", "hour_weekend", "line_hour")


@query
def q_label_encode(spark, d):
    base = reshape.with_congestion(reshape.with_period(_monthly_dated(spark, d)))
    base = calendar.with_month_third(base)
    out, _ = encode.label_encode(base)
    return out.select(*MONTH_KEYS, "line_idx", "station_idx", "period_idx", "congestion_idx", "month_third_idx")


def _enhanced_inputs(spark, d):
    base = calendar.with_weekday(V.v_clean(spark, d))
    base = enhance.with_rush_intensity(enhance.with_hour_flags(enhance.with_station_categories(base)))
    return base


@query
def q_station_categories(spark, d):
    out = enhance.with_station_categories(V.v_clean(spark, d))
    return out.select(*KEYS, "cat_business", "cat_commercial", "cat_transfer", "cat_university",
                      "cat_residential", "cat_group")


@query
def q_hour_flags(spark, d):
    out = enhance.with_hour_flags(V.v_clean(spark, d))
    return out.select(*KEYS, "f_morning", "f_evening_rush", "f_lunch", "f_late_night", "f_night")


@query
def q_rush_intensity(spark, d):
    return enhance.with_rush_intensity(V.v_clean(spark, d)).select(*KEYS, "rush_intensity")


@query
def q_interactions(spark, d):
    base = reshape.with_period(_enhanced_inputs(spark, d))
    base, _ = encode.label_encode(base, columns=("station", "period"))
    out = enhance.with_interactions(base)
    cols = ["time_dow", "station_time", "business_rush", "transfer_rush", "university_morning",
            "business_weekday", "commercial_weekend", "group_time_dow", "transfer_rush_weekday"]
    return out.select(*KEYS, *[r6(c).alias(c) if c in ("business_rush", "transfer_rush") else c for c in cols])


def _feature_table(spark, d):
    features, _ = pipeline.feature_chain(V.v_monthly(spark, d), V.fixture_holiday_dates())
    return features


def _enhanced_table(spark, d):
    return pipeline.enhance_features(_feature_table(spark, d))


@query
def q_flag_counts(spark, d):
    return profile.flag_counts(_enhanced_table(spark, d))


@query
def q_nonzero_counts(spark, d):
    e = _enhanced_table(spark, d)
    cols = ["cat_business", "cat_commercial", "cat_transfer", "f_morning", "rush_intensity", "business_rush",
            "transfer_rush", "commercial_weekend", "lag_1", "std_7"]
    return profile.nonzero_counts(e, cols)


@query
def q_station_profile(spark, d):
    return profile.station_profile(_enhanced_table(spark, d), "왕십리")


@query
def q_drop_target_leaks(spark, d):
    """The enhanced table's remaining columns and the row count that carries them."""
    e = _enhanced_table(spark, d)
    return profile.schema_report(e).select("col_pos", "column_name", "non_null")


@query
def q_feature_family(spark, d):
    e = _enhanced_table(spark, d)
    cols = enhance.feature_columns(e)
    nz = profile.nonzero_counts(e, cols)
    nz = nz.withColumn("source_name", enhance.source_name_column("column_name"))
    return nz.select(
        "column_name", "source_name", enhance.feature_family().alias("family"),
        enhance.is_new_feature().alias("is_new"), "nonzero",
    )


@query
def q_feature_table(spark, d):
    f = _feature_table(spark, d)
    dbl = [c for c, t in f.dtypes if t == "double"]
    return f.select(*[r6(c).alias(c) if c in dbl else F.col(c) for c in f.columns])


# --- phase 6: peak-relative congestion ------------------------------------------------------
def _peak(spark, d):
    return peak.with_peak(peak.hourly_totals(V.v_month(spark, d)))


PEAK_COLS = ["use_month", "line", "station", "hour", "passengers", "ride_on", "ride_off", "max_passengers",
             "congestion_percent", "peak_level", "is_peak"]


@query
def q_hourly_totals(spark, d):
    out = peak.hourly_totals(V.v_month(spark, d))
    return out.select(*MONTH_KEYS, "ride_on", "ride_off", "passengers_total")


@query
def q_peak_congestion(spark, d):
    return _peak(spark, d).select(*PEAK_COLS)


@query
def q_peak_at_hour(spark, d):
    return peak.at_hour(_peak(spark, d), "08").select(*PEAK_COLS)


@query
def q_congestion_bar(spark, d):
    return peak.with_bar(_peak(spark, d)).select("use_month", "line", "station", "hour", "congestion_percent", "bar")


# --- phase 7: scoring and lookup --------------------------------------------------------------
AS_OF_YEAR = 2024
AS_OF_MONTH = 1


def _codes(spark, d, clean=None):
    base = stats.with_transfer_by_name(V.v_clean(spark, d) if clean is None else clean)
    enc, _ = encode.label_encode(base, columns=("line", "station"))
    return score.code_table(enc)


def _scoring_inputs(spark, d):
    """One scan of the events: the daily table is written once as a stage
    table and requests, codes and probabilities all derive from it."""
    clean = checkpoint_stage(V.v_clean(spark, d), "clean", partition_by=["use_month"])
    return V.v_requests(spark, d, clean), _codes(spark, d, clean), V.v_prob(spark, d, clean)


def _scored(spark, d, scheme="training"):
    reqs, codes, probs = _scoring_inputs(spark, d)
    return score.score(reqs, codes, probs, AS_OF_YEAR, scheme)


REQ_KEYS = ["station", "line", "dow", "hour"]


@query
def q_validate_requests(spark, d):
    pairs = V.v_clean(spark, d).select("station", "line").distinct()
    raw = (
        pairs.withColumn("dow", F.explode(F.sequence(F.lit(-1), F.lit(7))))
        .withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(24))))
        .withColumn("month", F.when(F.col("hour") == 5, F.lit(None)).otherwise(F.col("hour") % 14).cast("int"))
        .withColumn("is_holiday", F.when(F.col("dow") == 3, F.lit(None)).otherwise(F.col("dow") == 0))
    )
    out = score.validate_requests(raw, AS_OF_MONTH)
    return out.select(*REQ_KEYS, "month", "is_holiday", "reject_reason")


@query
def q_serving_period(spark, d):
    return score.with_serving_period(V.v_clean(spark, d)).select(*KEYS, "serving_period")


@query
def q_request_features(spark, d):
    reqs = V.v_requests(spark, d)
    out = score.request_features(reqs, _codes(spark, d), AS_OF_YEAR)
    cols = ["period_idx", "quarter", "is_weekend", "is_holiday", "is_off_day", "station_idx", "line_idx",
            "is_transfer", "cat_transfer", "time_dow", "station_time", "group_time_dow", "transfer_rush_weekday"]
    return out.select(*REQ_KEYS, *cols, r6("dow_sin").alias("dow_sin"), r6("month_cos").alias("month_cos"))


@query
def q_base_level(spark, d):
    p = score.with_base_level(V.v_prob(spark, d))
    return p.select("station", "hour", "base_level")


@query
def q_adjust_level(spark, d):
    return _scored(spark, d).select(*REQ_KEYS, "base_level", "level")


@query
def q_format_prediction(spark, d):
    s = _scored(spark, d)
    return s.select(*REQ_KEYS, "level", "label", *[r6(f"p_{k}").alias(f"p_{k}") for k in range(4)],
                    "day_name", "is_weekend_req")


@query
def q_recommendation(spark, d):
    return _scored(spark, d).select(*REQ_KEYS, "level", "recommendation")


@query
def q_level_color(spark, d):
    return score.with_color(_scored(spark, d)).select(*REQ_KEYS, "level", "color")


def _profile(spark, d):
    reqs, codes, probs = _scoring_inputs(spark, d)
    day = reqs.filter(F.col("hour") == 0).drop("hour")
    # every request is made twice
    day = day.withColumn("request_id", F.explode(F.array(*[F.concat_ws("/", F.lit(k), "station", "line", "dow") for k in ("a", "b")])))
    return score.hourly_profile(day, codes, probs, AS_OF_YEAR)


@query
def q_hourly_profile(spark, d):
    p = _profile(spark, d)
    return p.select("request_id", "station", "line", "dow", "hour", "time", "level", "label", r6("probability").alias("probability"))


@query
def q_profile_summary(spark, d):
    s = score.profile_summary(_profile(spark, d))
    return s.select("request_id", "station", "line", "dow",
                    F.array_join("most_congested_hours", ",").alias("most_congested_hours"),
                    F.array_join("least_congested_hours", ",").alias("least_congested_hours"),
                    "average_congestion")


def _station_dim(spark, d):
    return stats.station_dim(V.v_monthly(spark, d))


@query
def q_search_stations(spark, d):
    return lookup.search_stations(_station_dim(spark, d), line="2-HIGH", pattern="^[신사]")


@query
def q_list_lines(spark, d):
    return lookup.list_lines(_station_dim(spark, d))


@query
def q_suggest(spark, d):
    return lookup.suggest(_station_dim(spark, d), "입구")


# --- phase 6b: landed payloads, holidays, files ----------------------------------------------------


def _payload(spark, d, col):
    return V.v_json(spark, d).select("event_id", F.col(col).alias("payload"))


@query
def q_flatten_ridership(spark, d):
    return payloads.flatten_ridership(_payload(spark, d, "ridership_json"))


@query
def q_flatten_arrivals(spark, d):
    return payloads.flatten_arrivals(_payload(spark, d, "arrivals_json"))


@query
def q_flatten_forecast(spark, d):
    return payloads.flatten_forecast(_payload(spark, d, "forecast_json"))


@query
def q_flatten_hourly(spark, d):
    return payloads.flatten_hourly(_payload(spark, d, "hourly_json"))


@query
def q_payload_peak(spark, d):
    return peak.response_peaks(_payload(spark, d, "hourly_json"))


@query
def q_unparsable_payloads(spark, d):
    """Landed texts of which every seventeenth is cut off, and every nineteenth missing."""
    e = F.col("event_id")
    p = _payload(spark, d, "arrivals_json")
    text = F.when(e % 17 == 0, F.expr("left(payload, length(payload) - 1)")).when(e % 19 != 0, F.col("payload"))
    return payloads.unparsable(p.withColumn("payload", text)).select("event_id")


@query
def q_head_rows(spark, d):
    return profile.head_rows(V.v_clean(spark, d), KEYS).select(*KEYS, "total")


@query
def q_no_lines(spark, d):
    """The fixed default list where the dimension is empty."""
    return lookup.list_lines(_station_dim(spark, d).filter("line is null"))


@query
def q_holiday_dim(spark, d):
    """The collector's 2025 holiday file, each day with the number of events
    that fell on the same month-day in the data."""
    days = V.v_clean(spark, d).groupBy(F.date_format("use_date", "MMdd").alias("mmdd")).agg(
        F.count(F.lit(1)).alias("n_rows"))
    hd = dims.holiday_dim(spark).withColumn("mmdd", F.substring("date", 5, 4))
    out = hd.join(F.broadcast(days), on="mmdd", how="left")  # at most 366 month-days: bounded by the calendar
    return out.select("date", "is_holiday", "holiday_name", "holiday_date",
                      F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))


@query
def q_is_holiday(spark, d):
    days = V.v_clean(spark, d).select("use_date").distinct()
    return calendar.with_is_holiday(days, dims.holiday_dates(spark), "use_date", holiday_date_col="date")


@query
def q_csv_roundtrip(spark, d):
    """v_wide written as a cp949 CSV with the source headers, read back with
    the raw reader and reshaped."""
    path = _scratch(spark, "wide-csv")
    wide = V.v_wide(spark, d)
    # counts occur plainly, with a point and with thousands marks
    written = {c: F.when(F.col("use_month") % 3 == 0, F.concat(F.col(f"`{c}`").cast("string"), F.lit(".0")))
               .when(F.col("use_month") % 3 == 1, F.format_number(F.col(f"`{c}`"), 0)).otherwise(F.col(f"`{c}`").cast("string"))
               for c in wide.columns if c not in ("use_month", "line", "station")}
    io.write_wide_csv(wide.withColumns(written), path)
    back = io.read_wide_csv(spark, path)
    return reshape.wide_to_long(back).select(*MONTH_KEYS, "boardings", "alightings", "total")


@query
def q_stage_roundtrip(spark, d):
    """A labelled stage written as CSV with source headers, partitioned by
    month, and read back with types."""
    from pyspark.sql import types as T

    path = _scratch(spark, "stage-csv")
    labelled = reshape.with_congestion(V.v_clean(spark, d))
    io.write_stage(labelled, path, fmt="csv", partition_by=["use_month"], source_names=True)
    schema = T.StructType([
        T.StructField("use_month", T.IntegerType()), T.StructField("use_date", T.DateType()),
        T.StructField("line", T.StringType()), T.StructField("station", T.StringType()),
        T.StructField("hour", T.IntegerType()), T.StructField("total", T.LongType()),
        T.StructField("congestion", T.StringType()), T.StructField("level", T.IntegerType()),
    ])
    back = io.read_stage(spark, path, fmt="csv", schema=schema)
    return back.select(*KEYS, "use_month", "total", "congestion", "level")


@query
def q_schema_report(spark, d):
    return profile.schema_report(V.v_ridership(spark, d))


@query
def q_enhanced_table(spark, d):
    """The flagship chain: raw monthly counts -> cleaning -> features ->
    station categories and interactions, target-derived columns dropped."""
    e = _enhanced_table(spark, d)
    dbl = {c for c, t in e.dtypes if t == "double"}
    return e.select(*[r6(c).alias(c) if c in dbl else F.col(c) for c in e.columns])


# --- phase 8: split, metrics, forest ------------------------------------------------------------------

def _levels(spark, d):
    return reshape.with_congestion(V.v_clean(spark, d)).select(*KEYS, "total", "level")


@query
def q_stratified_split(spark, d):
    out = M.stratified_split(_levels(spark, d), "level", KEYS, order_cols=KEYS)
    return out.select(*KEYS, "level", "is_test")


@query
def q_balance_classes(spark, d):
    out = M.balance_classes(_levels(spark, d), "level", KEYS, order_cols=KEYS)
    return out.select(*KEYS, "level")


@query
def q_sample_rows(spark, d):
    return M.sample_rows(_levels(spark, d), 1000, KEYS).select(*KEYS, "level")


@query
def q_accuracy(spark, d):
    return M.accuracy(V.v_pred(spark, d)).select(r6("accuracy").alias("accuracy"))


@query
def q_weighted_f1(spark, d):
    return M.weighted_f1(V.v_pred(spark, d)).select(r6("weighted_f1").alias("weighted_f1"))


@query
def q_confusion(spark, d):
    c = M.confusion(V.v_pred(spark, d))
    return c.select("label", *[f"n_{k}" for k in range(4)], *[r6(f"pct_{k}").alias(f"pct_{k}") for k in range(4)])


@query
def q_class_report(spark, d):
    r = M.class_report(V.v_pred(spark, d))
    return r.select("row_label", *[r6(c).alias(c) for c in ["precision", "recall", "f1"]], "support")


@query
def q_overfit_report(spark, d):
    p = V.v_pred(spark, d)
    s = M.stratified_split(p, "label", KEYS, order_cols=KEYS)
    acc = s.agg(
        F.avg(F.when(~F.col("is_test"), (F.col("label") == F.col("prediction")).cast("double"))).alias("train_accuracy"),
        F.avg(F.when(F.col("is_test"), (F.col("label") == F.col("prediction")).cast("double"))).alias("test_accuracy"),
    )
    out = M.overfit_report(acc)
    return out.select(*[r6(c).alias(c) for c in ["train_accuracy", "test_accuracy", "gap"]], "verdict")


RF_KEYS = ["use_date", "line", "station", "hour"]
RF_TRAINED_AT = datetime.datetime(2024, 1, 1)
_fitted: dict[tuple, str] = {}


def _forest_path(spark, d):
    """The folder of the source's forest (100 trees, depth 20, smallest split 50), fitted on the training part once per
    application and state of the input files: the split table, the forest as fitted and collapsed, and the published
    model with its four metrics."""
    key = (spark.sparkContext.applicationId, d, versions.input_stamp(spark, [f"{d}/orders.parquet"]))
    path = _fitted.get(key)
    if path is None or versions.latest(spark, path) is None:
        path = _scratch(spark, "forest")
        e = _enhanced_table(spark, d)
        M.stratified_split(e, "level", RF_KEYS).write.parquet(f"{path}/split")
        split = spark.read.parquet(f"{path}/split")
        feats = enhance.feature_columns(e)
        m = M.fit_forest(split.filter(~F.col("is_test")), feats, "level", path=path)
        metrics = M.fit_metrics(M.predict(m, split, "level"))
        M.save_model(m, path, feats, metrics, note="station categories and interaction features", trained_at=RF_TRAINED_AT)
        _fitted[key] = path
    return path


def _forest(spark, d):
    """(split table, features, model, its metadata), as loaded from the published version."""
    path = _forest_path(spark, d)
    m, meta = M.load_model(spark, path)
    return spark.read.parquet(f"{path}/split"), list(m.stages[0].getInputCols()), m, meta


def _forest_nodes(spark, d):
    path = _forest_path(spark, d)
    return FN.read_nodes(spark, f"{path}/{versions.latest(spark, path)}/model")


def _test_scores(spark, d):
    split, _, m, _ = _forest(spark, d)
    return M.predict(m, split.filter("is_test"), "level")


def _probability_checks(p):
    """Of scored rows: the probabilities' sum, and whether the prediction is their first maximum."""
    return [F.round(F.aggregate("probs", F.lit(0.0), lambda s, x: s + x), 6).alias("prob_sum"),
            (F.col("prediction") == F.array_position("probs", F.array_max("probs")) - 1).alias("is_argmax")]


def _close(a, b):
    return F.abs(a - b) < 1e-9


# a forest's numbers have no SQL form: the queries return them, tests compare them with the node table's plain
# evaluation, and the _checks queries state in SQL what every right run fulfils
@query
def q_rf_predict(spark, d):
    """Every test row's prediction and class probabilities."""
    p = _test_scores(spark, d)
    return p.select(*RF_KEYS, "level", "prediction", *[r6(F.col("probs")[k]).alias(f"p_{k}") for k in range(4)])


@query
def q_rf_predict_checks(spark, d):
    """Every test row: sum and argmax of its probabilities, and whether walking the node table gives the same."""
    p = _test_scores(spark, d)
    split, feats, _, _ = _forest(spark, d)
    walked = FN.evaluate(split.filter("is_test"), _forest_nodes(spark, d), feats, RF_KEYS, M.DEFAULT_FOREST["maxDepth"])
    walked = walked.select(*RF_KEYS, F.col("probs").alias("walked"), F.col("prediction").alias("walked_to"))
    same = F.forall(F.zip_with("probs", "walked", _close), lambda x: x) & (F.col("prediction") == F.col("walked_to"))
    return p.join(walked, RF_KEYS, "left").select(*RF_KEYS, "level", *_probability_checks(p), F.coalesce(same, F.lit(False)).alias("nodes_agree"))


@query
def q_rf_scores(spark, d):
    """The test rows' predictions and probabilities as an array."""
    return _test_scores(spark, d).select(*RF_KEYS, "level", "prediction", F.transform("probs", lambda x: F.round(x, 6)).alias("probs"))


def _importance(spark, d):
    _, feats, m, _ = _forest(spark, d)
    imp = M.feature_importance(m, feats)
    return imp.withColumns({"source_name": enhance.source_name_column("feature"), "family": enhance.feature_family()})


@query
def q_rf_importance(spark, d):
    return _importance(spark, d).select("feature", "source_name", "family", r6("importance").alias("importance"))


@query
def q_rf_importance_checks(spark, d):
    """Per feature: family, range, the sum over all, and whether gains summed over the node table give the same."""
    imp = _importance(spark, d)
    _, feats, _, _ = _forest(spark, d)
    walked = FN.node_importance(_forest_nodes(spark, d), feats).withColumnRenamed("importance", "walked")
    total = imp.agg(F.round(F.sum("importance"), 6)).scalar()
    return imp.join(walked, "feature", "left").select(
        "feature", "source_name", "family", F.col("importance").between(0, 1).alias("in_range"), total.alias("total"),
        F.coalesce(_close(F.col("importance"), F.col("walked")), F.lit(False)).alias("nodes_agree"))


@query
def q_rf_min_split(spark, d):
    """The forest as fitted and as collapsed: its nodes, the fewest rows of a split node, and the test accuracy."""
    path = _forest_path(spark, d)
    test = spark.read.parquet(f"{path}/split").filter("is_test")
    out = None
    for name in ("fitted", "collapsed"):
        nodes = FN.read_nodes(spark, f"{path}/{name}")
        accuracy = M.accuracy(M.predict(M.PipelineModel.load(f"{path}/{name}"), test, "level"), "level").scalar()
        part = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("left") >= 0).alias("splits"), F.min(F.when(F.col("left") >= 0, F.col("n"))).alias("smallest_split"))
        part = part.select(F.lit(name).alias("forest"), "nodes", "splits", "smallest_split", r6(accuracy).alias("test_accuracy"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def q_rf_min_split_checks(spark, d):
    """No split node below 50 rows, no leaf below 20, every tree with one root, both children of every split there."""
    n = _forest_nodes(spark, d)
    kids = n.filter("left >= 0").select("tree", F.explode(F.array("left", "right")).alias("node"))
    found = n.join(kids.withColumn("child", F.lit(1)), ["tree", "node"], "left")
    return found.agg(
        F.countDistinct("tree").alias("trees"), (F.min(F.when(F.col("left") >= 0, F.col("n"))) >= M.MIN_SPLIT).alias("splits_fit"),
        (F.min("n") >= M.DEFAULT_FOREST["minInstancesPerNode"]).alias("leaves_fit"), F.count_if(F.col("child").isNull()).alias("roots"),
        (F.count(F.lit(1)) == 2 * F.count_if(F.col("left") >= 0) + F.countDistinct("tree")).alias("binary"))


def _overfit(spark, d):
    split, _, m, _ = _forest(spark, d)
    p = M.predict(m, split, "level")
    hit = (F.col("level") == F.col("prediction")).cast("double")
    acc = p.agg(F.count_if(~F.col("is_test")).alias("train_rows"), F.count_if("is_test").alias("test_rows"),
                F.avg(F.when(~F.col("is_test"), hit)).alias("train_accuracy"), F.avg(F.when(F.col("is_test"), hit)).alias("test_accuracy"))
    return split, M.overfit_report(acc)


@query
def q_rf_overfit(spark, d):
    """One row: sizes and accuracies of both parts, their gap and the verdict."""
    _, r = _overfit(spark, d)
    return r.select("train_rows", "test_rows", *[r6(c).alias(c) for c in ("train_accuracy", "test_accuracy", "gap")], "verdict")


@query
def q_rf_overfit_checks(spark, d):
    """One row: sizes of both parts and what the report must fulfil."""
    split, r = _overfit(spark, d)
    majority = split.filter("is_test").groupBy("level").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n") / F.sum("n")).scalar()
    verdict = F.when(F.col("gap") < 0.05, "none").when(F.col("gap") < 0.10, "slight").otherwise("severe")
    return r.select("train_rows", "test_rows", _close(F.col("train_accuracy") - F.col("test_accuracy"), F.col("gap")).alias("gap_fits"),
                    (F.col("verdict") == verdict).alias("verdict_fits"), (F.col("test_accuracy") >= majority).alias("beats_majority"))


_curves: dict[str, str] = {}


def _curve(spark, d):
    """The source's curve of its own forest, from training rows only; computed once per fitted forest."""
    path = _forest_path(spark, d)
    if path not in _curves:
        split = spark.read.parquet(f"{path}/split").filter(~F.col("is_test")).drop("is_test")
        feats = list(M.load_model(spark, path)[0].stages[0].getInputCols())
        M.learning_curve(split, feats, "level", RF_KEYS).write.parquet(f"{path}/curve")
        _curves[path] = f"{path}/curve"
    return spark.read.parquet(_curves[path])


@query
def q_learning_curve(spark, d):
    out = _curve(spark, d)
    return out.select("train_size", *[r6(c).alias(c) for c in ("train_mean", "train_std", "val_mean", "val_std")])


@query
def q_learning_curve_checks(spark, d):
    ok = F.col("train_mean").between(0, 1) & F.col("val_mean").between(0, 1) & (F.col("train_std") >= 0) & (F.col("val_std") >= 0)
    return _curve(spark, d).select("train_size", ok.alias("scores_fit"))


@query
def q_model_info(spark, d):
    """The published model's metadata with its metrics."""
    info = M.model_info(_forest(spark, d)[3])
    metrics = ("train_accuracy", "test_accuracy", "train_f1", "test_f1")
    return info.select("model_type", "train_date", "feature_count", F.array_join("features", ",").alias("features"), "note", *[r6(c).alias(c) for c in metrics])


@query
def q_model_info_checks(spark, d):
    """The metadata, and whether the metrics equal those of the node table's plain evaluation of every row."""
    split, feats, _, meta = _forest(spark, d)
    walked = FN.evaluate(split, _forest_nodes(spark, d), feats, [*RF_KEYS, "level", "is_test"], M.DEFAULT_FOREST["maxDepth"])
    same = F.lit(True)
    for k, v in M.fit_metrics(walked).items():
        same &= _close(F.col(k), F.lit(v))
    return M.model_info(meta).select("model_type", "train_date", "feature_count", F.array_join("features", ",").alias("features"), "note",
                                     same.alias("metrics_fit"), (F.col("train_accuracy") > 0).alias("trained"))


def _forest_profile(spark, d):
    split, feats, m, _ = _forest(spark, d)
    codes = score.code_table(split)
    pairs = V.v_monthly(spark, d)
    reqs = V.v_requests(spark, d, pairs).filter(F.col("hour") == 0).drop("hour")
    f = score.request_features(score.day_requests(reqs), codes, AS_OF_YEAR, model_features=feats)
    p = M.predict(m, f.withColumn("level", F.lit(0)), "level").drop("level")
    return score.adjust_level(score.with_base_level(p))


PROFILE_KEYS = ["station", "line", "dow", "hour", "station_idx", "line_idx", "is_transfer"]


@query
def q_rf_hourly_profile(spark, d):
    """Serving with the forest: day requests -> serving features (missing
    model features = 0) -> class probabilities -> adjusted 24-hour profile."""
    s = _forest_profile(spark, d)
    return s.select(*PROFILE_KEYS, "base_level", "level", r6(F.get("probs", F.col("level"))).alias("probability"))


@query
def q_rf_hourly_profile_checks(spark, d):
    s = _forest_profile(spark, d)
    return s.select(*PROFILE_KEYS, *_probability_checks(s), F.col("level").between(0, 3).alias("level_fits"))


# --- phase 9: streaming ----------------------------------------------------------------------------
@query
def q_arrivals_stream(spark, d):
    from ridelens.streaming.arrivals import arrivals_table

    return arrivals_table(spark, d)


@query
def q_request_features_serving(spark, d):
    """Parity mode (T11): the serving code's 7 ordinal period buckets."""
    reqs = V.v_requests(spark, d)
    out = score.request_features(reqs, _codes(spark, d), AS_OF_YEAR, period_scheme="serving")
    return out.select(*REQ_KEYS, "period_idx", "time_dow", "station_time", "group_time_dow")


TIME_FEATURES = ["hour", "hour_sin", "hour_cos", "dow", "is_weekend"]


@query
def q_rf_time_importance(spark, d):
    """The named time features (the source's quick lookup)."""
    return _importance(spark, d).filter(F.col("feature").isin(TIME_FEATURES)).select("feature", r6("importance").alias("importance"))


@query
def q_rf_time_importance_checks(spark, d):
    return q_rf_importance_checks(spark, d).filter(F.col("feature").isin(TIME_FEATURES)).select("feature", "in_range", "nodes_agree")


@query
def q_hash_split(spark, d):
    """The split that the forest uses: by hash order, through bucket counts."""
    return M.stratified_split(_levels(spark, d), "level", KEYS).select(*KEYS, "level", "is_test")


@query
def q_payload_peak_stream(spark, d):
    from ridelens.streaming.peaks import peak_table

    return peak_table(spark, d)


@query
def q_drop_target_leaks_strict(spark, d):
    """Strict mode (T7): the leaks that the source's list misses go as well."""
    e = pipeline.enhance_features(_feature_table(spark, d), strict=True)
    return profile.schema_report(e).select("col_pos", "column_name", "non_null")


# --- month by month ---------------------------------------------------------------------------------
_monthly: dict[tuple, monthly.MonthlyTables] = {}


def _monthly_tables(spark, d):
    """All months but the last three as one batch, then those one by one; appended once per application and state of
    the input files."""
    key = (spark.sparkContext.applicationId, d, versions.input_stamp(spark, [f"{d}/orders.parquet"]))
    tables = _monthly.get(key)
    if tables is None or versions.latest(spark, tables.path) is None:
        rows = checkpoint_stage(_monthly_dated(spark, d), "months", partition_by=["use_month"])
        months = sorted(r[0] for r in rows.select("use_month").distinct().collect())
        tables = monthly.MonthlyTables(spark, _scratch(spark, "monthly"))
        alone = months[-3:] if len(months) > 3 else months[1:]
        tables.append(rows.filter(F.col("use_month") < alone[0]) if alone else rows)
        for m in alone:
            tables.append(rows.filter(F.col("use_month") == m))
        _monthly[key] = tables
    return tables


@query
def q_monthly_history(spark, d):
    """Lags and rolling windows of months that were appended one after another."""
    f = _monthly_tables(spark, d).features()
    return f.select(*MONTH_KEYS, "total", "lag_1", "lag_7", *[r6(c).alias(c) for c in ["ma_3", "ma_7", "std_7"]])


@query
def q_monthly_stats(spark, d):
    """Means and extremes per station, hour and line, merged from the months' partial statistics."""
    t = _monthly_tables(spark, d).stats()
    value = F.coalesce("station", F.col("hour").cast("string"), "line")
    return t.select(F.col("_set").alias("key_name"), value.alias("key_value"), r6("_avg").alias("mean_total"), F.col("_max").alias("max_total"),
                    F.col("_min").alias("min_total"), F.col("_n").alias("n_rows"))


@query
def q_monthly_means(spark, d):
    """The merged statistics joined back onto the appended rows."""
    t = _monthly_tables(spark, d)
    found = t.stats()
    out = stats.with_station_extremes(stats.with_group_means(t.features(), stats=found), stats=found)
    return out.select(*MONTH_KEYS, *[r6(c).alias(c) for c in ["station_avg", "hour_avg", "line_avg"]], "station_max", "station_min")


@query
def q_monthly_codes(spark, d):
    """The append-only label codes: by the first batch that has a value, then by value."""
    return _monthly_tables(spark, d).codes()


@query
def q_monthly_distinct(spark, d):
    """Distinct lines, stations and hours from the months' merged bitmaps."""
    return _monthly_tables(spark, d).distinct_counts()


@query
def q_duplicate_bits(spark, d):
    """Rows beyond the first per (month, line, station), by bitmaps over dense codes (B2)."""
    r = checkpoint_stage(V.v_ridership(spark, d).select("use_month", "line", "station"), "keys")
    return monthly.duplicate_count(r, ["line", "station"], partials.extend_codes(None, r, ["line", "station"]))


@query
def q_payload_outcomes(spark, d):
    """Every landed text of three kinds with what became of it: rows, or the reason of its rejection."""
    e = F.col("event_id")
    p = _payload(spark, d, "arrivals_json")
    text = F.when(e % 17 == 0, F.expr("left(payload, length(payload) - 1)")).when(e % 23 == 0, F.lit("[1, 2]")).when(e % 19 != 0, F.col("payload"))
    stage, _ = payloads.payload_stage(p.withColumn("payload", text), payloads.ARRIVALS)
    return payloads.outcomes(stage, payloads.ARRIVALS)
