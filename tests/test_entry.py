import __spark_entry__ as E
from ridelens.plans.oracle import ORACLE
from ridelens.plans.queries import QUERIES

# a forest's numbers have no SQL form; all but rf_scores have a _checks query with SQL beside them
ROWS_ONLY = {"rf_scores", "rf_predict", "rf_importance", "rf_time_importance", "rf_min_split", "rf_overfit", "learning_curve", "model_info",
             "rf_hourly_profile"}


def test_registry_and_oracle_keys():
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q) and set(QUERIES) <= set(q)
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY
    assert len(QUERIES) >= 94
    assert {n for n in ROWS_ONLY if f"{n}_checks" in ORACLE} == ROWS_ONLY - {"rf_scores"}


def test_entry_runs_on_smallest_tables(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"level", "station", "line", "use_date", "cat_transfer", "group_time_dow"} <= set(df.columns)
