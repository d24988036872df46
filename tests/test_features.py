import datetime

from pyspark.sql import functions as F

from ridelens.operators import calendar, encode, enhance, peak, stats, windows
from ridelens.sources import dims


def _hist(spark):
    rows = []
    for i, v in enumerate([10, 20, 30, 40, 50, 60, 70, 80, 90]):
        d = datetime.date(2024, 1 + i, 1)
        rows.append(("강남", "2호선", 8, d, float(v)))
        rows.append(("강남", "1호선", 8, d, float(v + 1)))  # same date, other line: ordered by line (T10)
    return spark.createDataFrame(rows, "station string, line string, hour int, use_date date, total double")


def test_lags_and_rolling(spark):
    out = windows.with_history_features(_hist(spark)).orderBy("use_date", "line").collect()
    totals = [r.total for r in out]
    # rows, not days: lag_1 is the previous row of the (station, hour) history
    assert [r.lag_1 for r in out] == [0.0] + totals[:-1]
    assert [r.lag_7 for r in out] == [0.0] * 7 + totals[:-7]
    assert out[2].ma_3 == sum(totals[0:3]) / 3 and out[0].ma_3 == totals[0]
    assert out[0].std_7 == 0.0  # one row: sample std undefined -> 0
    import statistics

    assert abs(out[6].std_7 - statistics.stdev(totals[0:7])) < 1e-9


def test_group_means_and_extremes(spark):
    df = spark.createDataFrame([("a", "L1", 1, 10), ("a", "L2", 2, 20), ("b", "L1", 1, 30)],
                               "station string, line string, hour int, total long")
    out = {r.station + r.line: r for r in stats.with_station_extremes(stats.with_group_means(df)).collect()}
    assert out["aL1"].station_avg == 15 and out["aL1"].hour_avg == 20 and out["aL1"].line_avg == 20
    assert (out["aL2"].station_max, out["aL2"].station_min) == (20, 10)


def test_three_transfer_notions_stay_separate(spark):
    # Name rule, distinct-line rule, category grade
    df = spark.createDataFrame([("왕십리", "경의-중앙선"), ("왕십리", "2호선"), ("강남", "2호선")], "station string, line string")
    by_name = {r.line: r.is_transfer for r in stats.with_transfer_by_name(df).collect()}
    assert by_name == {"경의-중앙선": 1, "2호선": 0}
    dim = {(r.station, r.line): r.is_transfer for r in stats.station_dim(df).collect()}
    assert dim[("왕십리", "2호선")] is True and dim[("강남", "2호선")] is False
    cats = {r.station: r.cat_transfer for r in enhance.with_station_categories(df).collect()}
    assert cats == {"왕십리": 4, "강남": 2}


def test_weekday_and_holiday_flags(spark):
    days = spark.createDataFrame([(datetime.date(2025, 10, 2),), (datetime.date(2025, 10, 3),),
                                  (datetime.date(2025, 10, 4),), (datetime.date(2025, 10, 10),)], "use_date date")
    out = calendar.with_holiday_flags(calendar.with_weekday(days), dims.holiday_dates(spark)).orderBy("use_date").collect()
    assert [r.dow for r in out] == [3, 4, 5, 4] and out[0].day_name == "Thursday"
    assert [r.is_holiday for r in out] == [0, 1, 0, 0]
    assert [r.holiday_eve for r in out] == [1, 0, 1, 0]  # 10-03 and 10-05 are holidays
    assert [r.holiday_next for r in out] == [0, 0, 1, 1]
    assert [r.is_off_day for r in out] == [0, 1, 1, 0]


def test_two_holiday_lists(spark):
    # The collector's 2025 file has 11 days, the pipeline's 2025 part has 17
    from ridelens.functions import constants as K

    assert dims.holiday_dim(spark).count() == 11
    assert len([d for d in K.HOLIDAYS if d.startswith("2025")]) == 17
    assert dims.holiday_dates(spark).count() == len(set(K.HOLIDAYS))


def test_label_encode_sorted_codes_and_nan(spark):
    df = spark.createDataFrame([("신촌",), ("강남",), (None,), ("강남",)], "station string")
    out, codes = encode.label_encode(df, columns=("station",))
    got = {r.station: r.station_idx for r in out.collect()}
    order = sorted(["신촌", "강남", "nan"])
    assert got == {"신촌": order.index("신촌"), "강남": order.index("강남"), None: order.index("nan")}


def test_combos_null_part_gives_null(spark):
    df = spark.createDataFrame([(8, 1, 0, "2호선"), (None, 1, 0, "2호선")], "hour int, dow int, is_weekend int, line string")
    out = encode.with_combos(df).collect()
    assert (out[0].hour_dow, out[0].line_hour) == ("8_1", "2호선_8") and out[1].hour_dow is None


def test_drop_target_leaks_strict(spark):
    # The default list misses rel_congestion, lags, std_7 and line_avg; strict drops them
    cols = ["total", "station_avg", "rel_congestion", "lag_1", "lag_7", "std_7", "line_avg", "hour", "level"]
    df = spark.createDataFrame([tuple(range(len(cols)))], ", ".join(f"{c} int" for c in cols))
    assert enhance.drop_target_leaks(df).columns == ["rel_congestion", "lag_1", "lag_7", "std_7", "line_avg", "hour", "level"]
    assert enhance.drop_target_leaks(df, strict=True).columns == ["hour", "level"]
    assert enhance.feature_columns(enhance.drop_target_leaks(df)) == ["rel_congestion", "lag_1", "lag_7", "std_7",
                                                                      "line_avg", "hour"]


def test_feature_family_on_source_names(spark):
    # The encoded station column's source name contains the category mark
    df = spark.createDataFrame([("station_idx",), ("cat_group",), ("business_rush",), ("hour",), ("f_morning",)],
                               "column_name string")
    out = df.withColumn("source_name", enhance.source_name_column()).select(
        "column_name", enhance.feature_family().alias("f"), enhance.is_new_feature().alias("n")).collect()
    got = {r.column_name: (r.f, r.n) for r in out}
    assert got == {"station_idx": ("category", True), "cat_group": ("category", True),
                   "business_rush": ("interaction", True), "hour": ("basic", False), "f_morning": ("basic", True)}


def test_peak_relative(spark):
    rows = [(202401, "2호선", "강남", h, float(v), 0.0) for h, v in [(7, 50), (8, 100), (9, 100), (10, 39.9), (11, 0)]]
    df = spark.createDataFrame(rows, "use_month int, line string, station string, hour int, boardings double, alightings double")
    out = peak.with_bar(peak.with_peak(peak.hourly_totals(df))).orderBy("hour").collect()
    assert [r.hour for r in out] == [7, 8, 9, 10]  # zero-rider hour dropped
    assert [r.is_peak for r in out] == [False, True, True, False]  # ties are all peaks
    assert [r.peak_level for r in out] == ["보통", "매우혼잡", "매우혼잡", "여유"]
    assert out[0].bar == "█" * 10 and out[3].congestion_percent == 39.9
    assert peak.at_hour(peak.with_peak(peak.hourly_totals(df)), "08").count() == 1


def test_station_profile_plan_has_no_nested_loop(spark):
    from ridelens.operators import profile

    df = spark.createDataFrame([("a", 1, 2, 3), ("a", 1, 2, 0), ("a", 1, 2, 3), ("b", 0, 0, 1)],
                               "station string, cat_transfer int, cat_group int, level int")
    out = profile.station_profile(df, "a")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert [tuple(r) for r in out.collect()] == [("a", 3, 1, 2, 0, 1), ("a", 3, 1, 2, 3, 2)]


def test_quantiles_match_numpy(spark):
    import random

    import numpy as np

    from ridelens.operators.quantiles import quantile_table

    rng = random.Random(3)
    rows = [(rng.choice([None, rng.randrange(30), rng.randrange(100000)]), rng.gauss(0, 1), None) for _ in range(997)]
    out = quantile_table(spark.createDataFrame(rows, "a long, b double, c double"), ["a", "b", "c"], [0, 0.25, 0.5, 0.9, 1]).first()
    for i, c in enumerate("ab"):
        want = np.quantile([r[i] for r in rows if r[i] is not None], [0, 0.25, 0.5, 0.9, 1])
        assert np.allclose(out[c], want)
    assert out["c"] == [None] * 5


def test_quantiles_of_hard_values_match_sorting(spark):
    """Sizes from the smallest to infinity, both signs, long ties, values that share one bucket."""
    import math
    import random

    from ridelens.operators.quantiles import quantiles

    rng = random.Random(4)
    hard = [0.0, -0.0, 5e-324, -5e-324, 2.2e-308, 1e308, -1e308, 1.7e308, float("inf"), float("-inf"), 4095.5, 4096.0, 8191.0, 8192.0, 8193.0]
    near = [1000.0 + i * 2.0**-30 for i in range(500)]  # one first bucket
    a = hard + [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(400)]
    b = near + [near[7]] * 300 + [1000.0 + 499 * 2.0**-30 + math.ulp(1000.0)]
    c = [rng.randrange(2**62) for _ in range(300)]
    n = max(map(len, (a, b, c)))
    rows = [tuple(v[i] if i < len(v) else None for v in (a, b, c)) for i in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, c long")
    probs = [0, 0.01, 0.25, 1 / 3, 0.5, 0.77, 1]
    got = quantiles(df, ["a", "b", "c"], probs)
    for name, values in zip("abc", (a, b, [float(x) for x in c])):
        ordered = sorted(values)
        for p, found in zip(probs, got[name]):
            place = p * (len(ordered) - 1)
            low, high = ordered[math.floor(place)], ordered[math.ceil(place)]
            assert found == (low if low == high else low + (high - low) * (place - math.floor(place)))


def test_quantiles_with_nan_and_without_rows(spark):
    import math

    from ridelens.operators.quantiles import quantiles

    df = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "a double")
    q = quantiles(df, ["a"], [0, 0.5, 1])["a"]
    assert q[:2] == [1.0, 2.0] and math.isnan(q[2])  # NaN is the largest
    assert quantiles(df.limit(0), ["a"], [0.5]) == {"a": [None]}


def test_quantiles_of_counts_take_one_pass(spark):
    """Counts below 8,192 have a bucket each: no second histogram, no sort, no range exchange, no written stage."""
    from ridelens import session
    from ridelens.operators import clean, quantiles

    df = spark.range(20_000).select((F.col("id") % 8000).alias("total"))
    passes, hist = [], quantiles._hist
    quantiles._hist = lambda *a: passes.append(1) or hist(*a)
    before = len(session._stages)
    try:
        plan = clean.cap_outliers(df, ["total"])._jdf.queryExecution().executedPlan().toString()
    finally:
        quantiles._hist = hist
    assert len(passes) == 1 and len(session._stages) == before and "Exchange" not in plan and "Sort" not in plan


def test_two_slot_columns_of_one_hour_raise(spark):
    import pytest

    from ridelens import schemas
    from ridelens.operators import reshape

    c = schemas.boarding_column(8)
    with pytest.raises(ValueError, match="two slot columns"):
        reshape.slot_columns(spark.createDataFrame([(1, 2)], [c, c + " "]), schemas.BOARDING_MARK)
