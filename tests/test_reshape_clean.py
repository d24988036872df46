from pyspark.sql import functions as F

from ridelens.operators import clean, profile, reshape


def test_wide_to_long_row_count_and_nulls(wide_df):
    long = reshape.wide_to_long(wide_df)
    assert long.count() == 24 * wide_df.count()
    r = long.filter((F.col("station") == "역삼") & (F.col("hour") == 8)).first()
    assert r.boardings is None and r.alightings == 20 and r.total is None  # T5a: total null


def test_fill_then_total_is_zero_not_other_side(wide_df):
    # After fill_missing the total of a one-sided hour is 0, not 20
    long = clean.fill_missing(reshape.wide_to_long(wide_df))
    r = long.filter((F.col("station") == "역삼") & (F.col("hour") == 8)).first()
    assert (r.boardings, r.alightings, r.total) == (0, 20, 0)


def test_two_input_join_multiplies_repeated_keys(spark, wide_df):
    # A repeated (month, line, station) key multiplies in the equi-join, not in the one-pass stack
    dup = wide_df.filter(F.col("station") == "강남").unionByName(wide_df.filter(F.col("station") == "강남"))
    b = reshape.unpivot_hours(dup, "승차인원", "boardings")
    a = reshape.unpivot_hours(dup, "하차인원", "alightings")
    assert reshape.join_boarding_alighting(b, a).count() == 4 * 24
    assert reshape.wide_to_long(dup).count() == 2 * 24
    assert profile.duplicate_count(dup, ["use_month", "line", "station"]).first()[0] == 1


def test_hour_label_without_hour_raises(spark):
    import pytest

    df = spark.createDataFrame([(1, "a", "b", 3)], "use_month int, line string, station string, `xx 승차인원` long")
    with pytest.raises(ValueError):
        reshape.wide_to_long(df)


def test_normalize_names_strips_unicode_space(wide_df):
    # T4: tab and U+3000 are removed like Python's str.strip()
    out = reshape.normalize_names(wide_df).select("line", "station").collect()
    assert ("1호선", "신촌") in [(r.line, r.station) for r in out]
    assert " 1호선\t".strip() == "1호선" and "　신촌 ".strip() == "신촌"


def test_month_date_and_labels(wide_df):
    long = reshape.with_congestion(reshape.with_period(reshape.with_month_date(reshape.wide_to_long(wide_df))))
    r = long.filter((F.col("station") == "강남") & (F.col("hour") == 8)).first()
    assert str(r.use_date) == "2025-10-01" and (r.year, r.month) == (2025, 10)
    assert r.period == "출근시간"
    # total 900 + 50 = 950 -> 보통 / 1
    assert (r.congestion, r.level) == ("보통", 1)


def test_congestion_null_total_falls_to_last_class(spark):
    # A null total fails every comparison
    df = spark.createDataFrame([(None,), (499,), (500,), (2999,), (3000,)], "total long")
    out = [r.congestion for r in reshape.with_congestion(df).collect()]
    assert out == ["매우혼잡", "여유", "보통", "혼잡", "매우혼잡"]


def test_cap_outliers_order_and_bounds(spark):
    vals = [(-5,), (1,), (2,), (3,), (4,), (1000,)]
    df = spark.createDataFrame(vals, "total long")
    import numpy as np

    q1, q3 = np.quantile([v for (v,) in vals], [0.25, 0.75])  # raw values, before the clip (T5)
    ub = q3 + 1.5 * (q3 - q1)
    out = sorted(r.total for r in clean.cap_outliers(df, columns=["total"]).collect())
    expected = sorted(0.0 if v < 0 else (ub if v > 2 * ub else float(v)) for (v,) in vals)
    assert out == expected
    n = clean.outlier_counts(df, columns=["total"]).first()
    assert n.outlier_count == 1


def test_cap_all_zero_bound_zeroes_positive(spark):
    # T5d: Q3 = 0 gives a bound of 0, so every positive value becomes 0
    df = spark.createDataFrame([(0,), (0,), (0,), (0,), (7,)], "total long")
    assert [r.total for r in clean.cap_outliers(df, columns=["total"]).collect()] == [0.0] * 5


def test_replace_inf_and_counts(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (1.5,), (None,)], "x double")
    assert profile.inf_counts(df).first().inf_count == 2
    assert [r.x for r in clean.replace_inf(df, ["x"]).collect()] == [0.0, 0.0, 1.5, None]


def test_nonzero_counts_count_missing(spark):
    df = spark.createDataFrame([(0.0,), (None,), (2.0,), (float("nan"),)], "x double")
    assert profile.nonzero_counts(df, ["x"]).first().nonzero == 3  # T9: NaN != 0


def test_describe_matches_pandas(spark):
    import pandas as pd

    vals = [3, 1, 4, 1, 5, 9, 2, 6]
    df = spark.createDataFrame([(v,) for v in vals], "total long")
    d = profile.describe(df, "total").first()
    p = pd.Series(vals).describe()
    assert d["count"] == p["count"] and abs(d["std"] - p["std"]) < 1e-12
    assert (d.p25, d.p50, d.p75) == (p["25%"], p["50%"], p["75%"])


def test_null_counts_first_positive(wide_df):
    out = profile.null_counts(wide_df, only_positive=True, limit=3).collect()
    assert [r.null_count > 0 for r in out] == [True] * len(out)
    assert [r.col_pos for r in out] == sorted(r.col_pos for r in out)


def test_strip_matches_python_for_every_space_character(spark):
    # T4: every code point Python treats as white space is stripped, nothing else
    spaces = [chr(i) for i in range(0x110000) if chr(i).isspace()]
    rows = [(f"{c}{c}역{c}삼{c}",) for c in spaces] + [("​강남​",)]  # zero-width space is not white space
    df = spark.createDataFrame(rows, "station string")
    got = [r.station for r in reshape.normalize_names(df, columns=("station",)).collect()]
    assert got == [s.strip() for (s,) in rows]


def test_bad_month_gives_null_date_and_hour_forms(spark):
    from ridelens.operators import peak

    df = spark.createDataFrame([(202512,), (202513,)], "use_month int")
    out = {r.use_month: r.use_date for r in reshape.with_month_date(df).collect()}
    assert str(out[202512]) == "2025-12-01" and out[202513] is None  # no failure under ANSI mode
    hours = spark.createDataFrame([(8,), (9,)], "hour int")
    assert [peak.at_hour(hours, h).count() for h in (8, "8", "08", " 08 ")] == [1, 1, 1, 1]
