import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ridelens.session import local_session

    s = local_session(cores=4, shuffle_partitions=4, app="ridelens-tests")
    yield s


def wide_row(month, line, station, boardings, alightings):
    """A wide-table row: dicts hour -> count (missing hours are null)."""
    from ridelens import schemas

    row = {"use_month": month, "line": line, "station": station}
    for h in range(24):
        row[schemas.boarding_column(h)] = boardings.get(h)
        row[schemas.alighting_column(h)] = alightings.get(h)
    return row


@pytest.fixture()
def wide_df(spark):
    from pyspark.sql import types as T

    from ridelens import schemas

    fields = [T.StructField("use_month", T.IntegerType()), T.StructField("line", T.StringType()),
              T.StructField("station", T.StringType())]
    fields += [T.StructField(c, T.LongType()) for h in range(24)
               for c in (schemas.boarding_column(h), schemas.alighting_column(h))]
    schema = T.StructType(fields)
    rows = [
        wide_row(202510, "2호선", "강남", {h: 100 * (h + 1) for h in range(24)}, {h: 50 for h in range(24)}),
        # null boarding, non-null alighting at 08 (trap T5a)
        wide_row(202510, "2호선", "역삼", {h: 10 for h in range(24) if h != 8}, {h: 20 for h in range(24)}),
        # name padded with a tab and an ideographic space (trap T4)
        wide_row(202510, " 1호선\t", "　신촌 ", {0: 5}, {0: 6}),
        # negative and extreme counts (D2), then an all-zero station (T5d)
        wide_row(202510, "3호선", "사당", {0: -5, 1: 1_000_000}, {0: 1, 1: 1}),
        wide_row(202510, "3호선", "가상1", {h: 0 for h in range(24)}, {h: 0 for h in range(24)}),
    ]
    return spark.createDataFrame([tuple(r[f.name] for f in fields) for r in rows], schema)
