"""The operators against pandas itself (the source project's library) on
seeded random data: same shifts, rolling windows, quantiles, bins, names."""

import datetime
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ridelens.operators import calendar, clean, stats, windows


def _random_long(seed=3, n_dates=40):
    rng = random.Random(seed)
    rows = []
    start = datetime.date(2023, 1, 1)
    for st in ["강남", "신촌", "사당"]:
        for ln in ["1호선", "2호선"]:
            for h in [7, 8, 18]:
                for i in range(n_dates):
                    if rng.random() < 0.8:
                        rows.append((st, ln, h, start + datetime.timedelta(days=i), float(rng.randrange(0, 5000))))
    return rows


def test_history_features_match_pandas(spark):
    rows = _random_long()
    df = spark.createDataFrame(rows, "station string, line string, hour int, use_date date, total double")
    got = windows.with_history_features(df).toPandas()
    p = pd.DataFrame(rows, columns=["station", "line", "hour", "use_date", "total"])
    p = p.sort_values(["station", "use_date", "line"], kind="stable")  # line breaks the source's ties
    g = p.groupby(["station", "hour"])["total"]
    p["lag_1"] = g.shift(1)
    p["lag_7"] = g.shift(7)
    p["ma_3"] = g.transform(lambda x: x.rolling(window=3, min_periods=1).mean())
    p["ma_7"] = g.transform(lambda x: x.rolling(window=7, min_periods=1).mean())
    p["std_7"] = g.transform(lambda x: x.rolling(window=7, min_periods=1).std())
    cols = ["lag_1", "lag_7", "ma_3", "ma_7", "std_7"]
    p[cols] = p[cols].fillna(0)
    key = ["station", "line", "hour", "use_date"]
    m = p.merge(got, on=key, suffixes=("_pd", "_sp"))
    assert len(m) == len(p)
    for c in cols:
        assert np.allclose(m[f"{c}_pd"], m[f"{c}_sp"], rtol=1e-9, atol=1e-9), c


def test_cap_outliers_match_pandas(spark):
    rng = np.random.default_rng(5)
    vals = np.concatenate([rng.integers(-20, 400, 500), rng.integers(5000, 9000, 15)]).astype(float)
    df = spark.createDataFrame([(float(v),) for v in vals], "total double")
    got = sorted(r.total for r in clean.cap_outliers(df, columns=["total"]).collect())
    s = pd.Series(vals)
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    upper = q3 + 1.5 * (q3 - q1)
    s = s.clip(lower=0)
    s[s > upper * 2] = upper
    assert np.allclose(sorted(s.tolist()), got)


def test_group_means_match_pandas(spark):
    rows = _random_long(seed=9, n_dates=10)
    df = spark.createDataFrame(rows, "station string, line string, hour int, use_date date, total double")
    got = stats.with_group_means(df).toPandas()
    p = pd.DataFrame(rows, columns=["station", "line", "hour", "use_date", "total"])
    for key, name in [("station", "station_avg"), ("hour", "hour_avg"), ("line", "line_avg")]:
        means = p.groupby(key)["total"].mean().rename(name).reset_index()
        p = p.merge(means, on=key, how="left")
    m = p.merge(got, on=["station", "line", "hour", "use_date"], suffixes=("_pd", "_sp"))
    for c in ["station_avg", "hour_avg", "line_avg"]:
        assert np.allclose(m[f"{c}_pd"], m[f"{c}_sp"])


def test_calendar_matches_pandas(spark):
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(days=i) for i in range(0, 400, 3)]
    df = spark.createDataFrame([(d,) for d in days], "use_date date")
    hol = ["2024-01-01", "2024-02-10", "2024-05-06", "2024-10-09", "2024-12-25"]
    got = calendar.with_holiday_flags(
        calendar.with_quarter(calendar.with_month_third(calendar.with_weekday(df))), hol
    ).toPandas().sort_values("use_date")
    p = pd.DataFrame({"d": pd.to_datetime(days)})
    h = pd.to_datetime(hol)
    assert got["dow"].tolist() == p["d"].dt.dayofweek.tolist()
    assert got["day_name"].tolist() == p["d"].dt.day_name().tolist()
    assert got["quarter"].tolist() == p["d"].dt.quarter.tolist()
    third = pd.cut(p["d"].dt.day, bins=[0, 10, 20, 31], labels=["초", "중", "말"]).astype(str)
    assert got["month_third"].tolist() == third.tolist()
    assert got["is_holiday"].tolist() == p["d"].isin(h).astype(int).tolist()
    assert got["holiday_eve"].tolist() == (p["d"] + pd.Timedelta(days=1)).isin(h).astype(int).tolist()
    assert got["holiday_next"].tolist() == (p["d"] - pd.Timedelta(days=1)).isin(h).astype(int).tolist()


def test_profiles_match_pandas(spark):
    from ridelens.operators import profile

    rng = random.Random(4)
    rows = [(rng.choice([202401, 202402, None]), rng.choice(["1호선", "2호선", None]), rng.choice(["강남", "신촌"]),
             rng.choice([0, 1, 2, 3, None])) for _ in range(300)]
    df = spark.createDataFrame(rows, "use_month int, line string, station string, level int")
    p = pd.DataFrame(rows, columns=["use_month", "line", "station", "level"])
    d = profile.distinct_counts(df, ["use_month", "line", "station"]).first()
    assert (d.n_use_month, d.n_line, d.n_station) == tuple(p[c].nunique() for c in ["use_month", "line", "station"])
    dup = profile.duplicate_count(df, ["use_month", "line", "station"]).first()[0]
    assert dup == int(p.duplicated(subset=["use_month", "line", "station"]).sum())  # null keys compare equal
    vc = [(r.level, r.n) for r in profile.value_counts(df, "level").collect()]
    pv = p["level"].value_counts().sort_index()
    assert vc == [(int(k), int(v)) for k, v in pv.items()]
