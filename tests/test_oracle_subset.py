"""The driver's check on the smallest tables, for a spread of operators."""
import os

import duckdb
import pytest

from tools.oracle_check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
NAMES = ["top_stations", "wide_to_long", "cap_outliers", "group_means", "holiday_flags", "rolling", "label_encode",
         "peak_congestion", "adjust_level", "profile_summary", "flatten_hourly", "stratified_split", "class_report",
         "flatten_ridership", "flatten_arrivals", "validate_requests", "holiday_dim", "station_categories",
         "interactions", "null_counts", "outlier_counts", "feature_family", "monthly_history", "monthly_means", "monthly_codes",
         "monthly_distinct", "duplicate_bits", "payload_outcomes", "csv_roundtrip", "describe_total"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as E

    df = E.queries()[name](spark, SF)
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(dcols, res.fetchall())
