"""Months appended one after another against the whole history at once."""
import datetime
import random

import pytest
from pyspark.sql import functions as F

from ridelens.operators import partials as P
from ridelens.operators import stats, windows
from ridelens.plans import monthly


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    out = []
    for m in range(14):
        day = datetime.date(2024 + m // 12, m % 12 + 1, 1)
        for station in "abcd"[: 2 + m // 4]:
            for line in ["1", "2"] + (["z"] if m == 9 else []) + ([None] if m == 5 else []):
                for hour in (0, 8, 23):
                    if rng.random() < 0.8:
                        out.append((day.year * 100 + day.month, day, line, station, hour, rng.choice([None, rng.randrange(5000)])))
    return spark.createDataFrame(out, "use_month int, use_date date, line string, station string, hour int, total long")


def append_all(spark, rows, path, cuts):
    t = monthly.MonthlyTables(spark, str(path))
    months = sorted(r[0] for r in rows.select("use_month").distinct().collect())
    for a, b in zip([0, *cuts], [*cuts, len(months)]):
        t.append(rows.filter(F.col("use_month").isin(months[a:b])))
    return t


@pytest.fixture(scope="module")
def tables(spark, rows, tmp_path_factory):
    return append_all(spark, rows, tmp_path_factory.mktemp("monthly"), [6, 7, 8, 12])


def same(a, b):
    key = lambda r: str(tuple(r))
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in a.collect()), key=str) == sorted(
        (tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in b.collect()), key=str) or print(sorted(a.collect(), key=key)[:5], sorted(b.collect(), key=key)[:5])


def test_history_equals_the_whole_one(rows, tables):
    cols = ["use_date", "line", "station", "hour", "total", "lag_1", "lag_7", "ma_3", "ma_7", "std_7"]
    assert same(tables.features().select(*cols), windows.with_history_features(rows).select(*cols))


def test_carry_is_bounded(spark, rows, tables):
    carry = tables._read("carry", tables._published()[-1:])
    sizes = [r["n"] for r in carry.groupBy("station", "hour").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) == 7 and len(sizes) == rows.select("station", "hour").distinct().count()


def test_an_append_does_not_read_old_months(spark, rows, tables, tmp_path):
    """The batch's features come from the new rows and the carry alone: one scan of each."""
    t = append_all(spark, rows.filter("use_month < 202501"), tmp_path, [6])
    carry = t._read("carry", t._published()[-1:])
    written = str(tmp_path / "rows")
    rows.write.partitionBy("use_month").parquet(written)
    new = spark.read.parquet(written).filter("use_month = 202501")
    plan = monthly.append_history(carry, new.select(*carry.columns))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and "PartitionFilters: [isnotnull(use_month" in plan and "features" not in plan


def test_statistics_merge(spark, rows, tables):
    order = ["_set", "station", "hour", "line", "_avg", "_max", "_min", "_n"]
    whole = stats.group_stats(rows, ["station", "hour", "line"]).select(*order)
    assert same(tables.stats().select(*order), whole)


def test_codes_are_append_only(spark, rows, tables):
    names = tables._published()
    seen = {}
    for n in names:
        now = {(r["column_name"], r["value"]): r["code"] for r in tables._read("codes", [n]).collect()}
        assert all(now[k] == v for k, v in seen.items())
        for c in ("line", "station"):
            assert sorted(v for (cc, _), v in now.items() if cc == c) == list(range(sum(cc == c for cc, _ in now)))
        seen = now
    # the values of the first six months in order, then the line of month 10; a null is the text nan
    assert [seen["line", v] for v in ("1", "2", "nan", "z")] == [0, 1, 2, 3]
    assert [seen["station", v] for v in "abcd"] == [0, 1, 2, 3] and len(seen) == 8


def test_distinct_counts_by_bitmaps(rows, tables):
    want = rows.agg(*[F.countDistinct(c).alias(f"n_{c}") for c in ("line", "station", "hour")])
    assert same(tables.distinct_counts(), want)


def test_months_come_in_order_and_a_failed_batch_is_not_seen(spark, rows, tmp_path):
    t = append_all(spark, rows.filter("use_month < 202407"), tmp_path, [])
    with pytest.raises(ValueError, match="in order"):
        t.append(rows.filter("use_month = 202406"))
    n = t.features().count()
    # a batch that was written but never published
    rows.write.parquet(f"{t.path}/features/batch=dead")
    assert t.features().count() == n
    t.append(rows.filter("use_month = 202407"))
    assert t.features().count() == rows.filter("use_month <= 202407").count()
    t.append(rows.limit(0))  # an empty batch adds nothing
    assert t.features().count() == rows.filter("use_month <= 202407").count()
    assert t.stats().filter("_set = 'station'").agg(F.sum("_n")).first()[0] == rows.filter("use_month <= 202407").count()


def test_bitmaps_beyond_one_row_and_merged_twice(spark):
    df = spark.createDataFrame([(i * 7,) for i in range(20_000)] + [(None,), (0,), (139_993,)], "x long")
    bits = P.distinct_bits(df, {"x": F.col("x"), "even": F.when(F.col("x") % 2 == 0, F.col("x"))})
    assert bits.filter("name = 'x'").count() == 5  # 139,994 codes in rows of 32,768
    both = P.merge_bits(bits.unionByName(P.distinct_bits(df.filter("x < 100"), {"x": F.col("x")})))
    assert P.count_bits(both, ["x", "even", "none"]).first().asDict() == {"n_x": 20_000, "n_even": 10_000, "n_none": 0}


def test_duplicates_by_bitmaps(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (1, "a", "y"), (2, "a", "x"), (2, None, "x"), (2, None, "x"), (None, "a", "x"), (None, "a", "x")]
    df = spark.createDataFrame(rows, "use_month int, line string, station string")
    codes = P.extend_codes(None, df, ["line", "station"])
    assert monthly.duplicate_count(df, ["line", "station"], codes).first()[0] == 3
    assert monthly.duplicate_count(df.limit(0), ["line", "station"], codes).first()[0] == 0
