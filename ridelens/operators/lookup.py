"""Station lookup over the (station, line) dimension.

Totals are computed as a scalar subquery over the filtered rows (a global
count with partial aggregation), never as ``count(*) over ()``, which would
pull every row into one task. Result limits are the feature (a page of at
most 100 stations, 15 suggestions) and are applied after a total order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from ridelens.functions import constants as K
from ridelens.sources.dims import literal_table


def search_stations(dim: DataFrame, line: str | None = None, pattern: str | None = None,
                    limit: int = 100) -> DataFrame:
    """Stations on an exact line whose name matches a case-insensitive
    regular expression; ``total`` is the number of matches before the cap."""
    out = dim
    if line:
        out = out.filter(F.col("line") == F.lit(line))
    if pattern:
        out = out.filter(F.col("station").rlike("(?i)" + pattern))
    total = out.agg(F.count(F.lit(1))).scalar()
    page = out.orderBy("line", "station").limit(limit)
    return page.select("station", "line", "is_transfer", total.alias("total"))


def list_lines(dim: DataFrame) -> DataFrame:
    """Sorted distinct lines; the fixed default list when there are none."""
    lines = dim.select("line").filter(F.col("line").isNotNull()).distinct()
    n = lines.agg(F.count(F.lit(1))).scalar()
    schema = T.StructType([T.StructField("line", T.StringType())])
    default = literal_table(dim.sparkSession, [(x,) for x in K.DEFAULT_LINES], schema).filter(n == 0)
    return lines.unionByName(default).orderBy("line")


def suggest(dim: DataFrame, query: str, limit: int = 15) -> DataFrame:
    """Autocomplete: case-sensitive substring of the station name, one row
    per (station, line), first ``limit`` in name order."""
    q = query.strip()
    if not q:
        return dim.select("station", "line").limit(0)
    return (
        dim.filter(F.col("station").contains(q))
        .select("station", "line")
        .dropDuplicates(["station", "line"])
        .orderBy("station", "line")
        .limit(limit)
    )
