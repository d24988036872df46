"""Batch scoring: a table of requests instead of one HTTP call per request.

Requests are rows; the 24-hour profile is ``explode(sequence(0, 23))``
instead of a 24-iteration loop; station / line codes come from a
join against the per-(station, line) code table instead of a scan of the
feature table per request; class probabilities come from any source that
yields a 4-element array per row (a Spark ML model or an empirical table).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.functions import constants as K
from ridelens.functions import exprs as X
from ridelens.operators.enhance import with_hour_flags, with_interactions, with_rush_intensity, with_station_categories

# training period labels in code order (code = rank in sorted order)
TRAINING_PERIODS = sorted([K.PERIOD_MORNING, K.PERIOD_EVENING, K.PERIOD_LUNCH, K.PERIOD_LATE_NIGHT, K.PERIOD_OTHER])


def training_period_idx(hour: str = "hour") -> F.Column:
    lab = X.period_label(hour)
    expr = None
    for i, name in enumerate(TRAINING_PERIODS):
        expr = F.when(lab == name, F.lit(i)) if expr is None else expr.when(lab == name, F.lit(i))
    return expr.cast("int")


def validate_requests(df: DataFrame, as_of_month: int) -> DataFrame:
    """Adds ``reject_reason`` (null when valid), fills month with ``as_of_month``
    and is_holiday with false. Ranges: hour 0-23, dow 0-6, month 1-12."""
    reason = (
        F.when(F.col("hour").isNull() | ~X.between("hour", 0, 23), "hour")
        .when(F.col("dow").isNull() | ~X.between("dow", 0, 6), "day_of_week")
        .when(F.col("month").isNotNull() & ~X.between("month", 1, 12), "month")
    )
    return (
        df.withColumn("reject_reason", reason)
        .withColumn("month", F.coalesce(F.col("month"), F.lit(as_of_month)).cast("int"))
        .withColumn("is_holiday", F.coalesce(F.col("is_holiday"), F.lit(False)))
    )


def split_requests(df: DataFrame, as_of_month: int):
    v = validate_requests(df, as_of_month)
    return v.filter(F.col("reject_reason").isNull()).drop("reject_reason"), v.filter(F.col("reject_reason").isNotNull())


def with_serving_period(df: DataFrame, hour_col: str = "hour") -> DataFrame:
    return df.withColumn("serving_period", X.serving_period(hour_col))


def code_table(features: DataFrame) -> DataFrame:
    """(station, line) -> station_idx, line_idx, is_transfer from the feature
    table; for a pair seen many times the codes are identical, so any row
    (here the minimum) is the first row's value."""
    aggs = [F.min("station_idx").alias("station_idx"), F.min("line_idx").alias("line_idx")]
    if "is_transfer" in features.columns:
        return features.groupBy("station", "line").agg(*aggs, F.min("is_transfer").alias("is_transfer"))
    # without the column, a station with more than one line is a transfer
    codes = features.groupBy("station", "line").agg(*aggs)
    lines = codes.groupBy(F.col("station").alias("_s")).agg((F.count("line") > 1).cast("int").alias("is_transfer"))
    return codes.join(lines, F.col("station") == F.col("_s"), "left").drop("_s").withColumn("is_transfer", F.coalesce("is_transfer", F.lit(0)))


def request_features(df: DataFrame, codes: DataFrame, as_of_year: int, period_scheme: str = "training",
                     model_features=None) -> DataFrame:
    """Serving-time features for valid requests (station, line, hour, dow,
    month, is_holiday). ``period_scheme='serving'`` uses the 7 ordinal
    buckets of the serving code (parity mode); the default uses the training
    code of the 5 period labels, so training and serving agree."""
    c = F.col
    period = X.serving_period("hour") if period_scheme == "serving" else training_period_idx("hour")
    out = (
        df.withColumn("hour_sin", X.cyclic_sin("hour", 24))
        .withColumn("hour_cos", X.cyclic_cos("hour", 24))
        .withColumn("period_idx", period)
        .withColumn("dow_sin", X.cyclic_sin("dow", 7))
        .withColumn("dow_cos", X.cyclic_cos("dow", 7))
        .withColumn("month_sin", X.cyclic_sin("month", 12))
        .withColumn("month_cos", X.cyclic_cos("month", 12))
        .withColumn("year", F.lit(as_of_year))
        .withColumn("quarter", (F.floor((c("month") - 1) / 3) + 1).cast("int"))
        .withColumn("is_weekend", (c("dow") >= 5).cast("int"))
        .withColumn("is_off_day", ((c("dow") >= 5) | c("is_holiday")).cast("int"))
        .withColumn("is_holiday", c("is_holiday").cast("int"))
        .withColumn("holiday_eve", F.lit(0))
        .withColumn("holiday_next", F.lit(0))
    )
    out = with_rush_intensity(with_hour_flags(out))
    side = codes.withColumnRenamed("station", "_s").withColumnRenamed("line", "_l")
    out = out.join(side, (c("station") == c("_s")) & (c("line") == c("_l")), "left").drop("_s", "_l")
    out = out.withColumn("_known", c("station_idx").isNotNull())
    out = out.withColumn("station_idx", F.coalesce(c("station_idx"), F.lit(0)))
    if "line_idx" in codes.columns:
        out = out.withColumn("line_idx", F.coalesce(c("line_idx"), F.lit(0)))
    else:
        fallback = F.create_map(*[x for k, v in K.LINE_CODE_FALLBACK.items() for x in (F.lit(k), F.lit(v))])
        out = out.withColumn("line_idx", F.when(c("_known"), F.coalesce(fallback[c("line")], F.lit(0))).otherwise(F.lit(0)))
    out = out.drop("_known")
    if "is_transfer" in out.columns:
        out = out.withColumn("is_transfer", F.coalesce(c("is_transfer"), F.lit(0)))
    out = with_interactions(with_station_categories(out))
    if model_features is not None:
        for name in model_features:
            if name not in out.columns:
                out = out.withColumn(name, F.lit(0.0))
    return out


def with_probabilities(df: DataFrame, probs: DataFrame, on=("station", "hour")) -> DataFrame:
    """Attach an empirical probability table (probs array per key); keys
    without an entry get a uniform distribution."""
    side = probs
    out = df.join(side, on=list(on), how="left")
    uniform = F.array(*[F.lit(0.25) for _ in range(4)])
    return out.withColumn("probs", F.coalesce(F.col("probs"), uniform))


def with_base_level(df: DataFrame, probs_col: str = "probs") -> DataFrame:
    return df.withColumn("base_level", X.argmax_level(probs_col))


def adjust_level(df: DataFrame, probs_col: str = "probs") -> DataFrame:
    """Rule-adjusted level (needs base_level, hour, dow, cat_transfer, cat_business)."""
    return df.withColumn(
        "level", X.adjusted_level("base_level", probs_col, "hour", "dow", "cat_transfer", "cat_business")
    )


def format_prediction(df: DataFrame, probs_col: str = "probs") -> DataFrame:
    """Label, the four class probabilities, day name and weekend flag."""
    p = F.col(probs_col)
    return (
        df.withColumn("label", X.label_of_level("level"))
        .withColumn("p_0", F.element_at(p, 1))
        .withColumn("p_1", F.element_at(p, 2))
        .withColumn("p_2", F.element_at(p, 3))
        .withColumn("p_3", F.element_at(p, 4))
        .withColumn("day_name", X.day_name_ko("dow"))
        .withColumn("is_weekend_req", F.col("dow") >= 5)
    )


def with_recommendation(df: DataFrame) -> DataFrame:
    return df.withColumn("recommendation", X.recommendation("level", "hour"))


def with_color(df: DataFrame, level_col: str = "level") -> DataFrame:
    return df.withColumn("color", X.color_of_level(level_col))


def score(requests: DataFrame, codes: DataFrame, probs: DataFrame, as_of_year: int,
          period_scheme: str = "training", as_of_month: int | None = None) -> DataFrame:
    """Requests -> features -> probabilities -> adjusted level, label,
    recommendation. With ``as_of_month`` the requests are validated first
    (the range checks apply to single and 24-hour requests alike) and only
    valid ones are scored; ``split_requests`` returns the rejected ones."""
    if as_of_month is not None:
        requests, _ = split_requests(requests, as_of_month)
    f = request_features(requests, codes, as_of_year, period_scheme)
    f = with_probabilities(f, probs)
    f = adjust_level(with_base_level(f))
    return with_recommendation(format_prediction(f))


def day_requests(df: DataFrame) -> DataFrame:
    """One request per (station, line, dow, month, is_holiday) -> 24 rows."""
    return df.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))


def hourly_profile(day_reqs: DataFrame, codes: DataFrame, probs: DataFrame, as_of_year: int,
                   period_scheme: str = "training", as_of_month: int | None = None) -> DataFrame:
    """24 rows per day request: the request's other columns (an id, say), hour, 'HH:00', level, label and the
    probability of the adjusted class."""
    own = ["station", "line", "dow", "month", "is_holiday"]
    carried = [c for c in day_reqs.columns if c not in (*own, "hour")]
    renamed = day_reqs.withColumnsRenamed({c: f"_req_{c}" for c in carried})
    s = score(day_requests(renamed), codes, probs, as_of_year, period_scheme, as_of_month)
    return s.select(
        *[F.col(f"_req_{c}").alias(c) for c in carried], "station", "line", "dow", "month", "is_holiday", "hour",
        F.format_string("%02d:00", F.col("hour")).alias("time"),
        "level", "label",
        F.element_at(F.col("probs"), F.col("level") + 1).alias("probability"),
    )


def profile_summary(profile: DataFrame, id_col: str = "request_id", keys=("station", "line", "dow", "month", "is_holiday")) -> DataFrame:
    """Per day request (``id_col`` names it; equal requests with other ids are apart): first five hours at level >= 2,
    first five at level 0 (hour order) and the mean level rounded to 2 decimals. A group is one request's 24 hours,
    so the collected lists are bounded."""
    keys = (id_col, *keys)
    busy = F.slice(F.array_sort(F.collect_list(F.when(F.col("level") >= 2, F.col("hour")))), 1, 5)
    calm = F.slice(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.col("hour")))), 1, 5)
    return profile.groupBy(*keys).agg(
        busy.alias("most_congested_hours"),
        calm.alias("least_congested_hours"),
        F.round(F.avg("level"), 2).alias("average_congestion"),
    )
