"""The feature chain's statistics and histories, month by month.

A new month reads its own rows and small state tables, never the months before:

* ``features``: the history features of every row, by batch and month;
* ``carry``: the last seven rows of every (station, hour), all that lags and
  rolling windows of later rows can reach;
* ``partials``: sums, counts, extremes per station, hour and line of the batch;
* ``codes``: the append-only label codes;
* ``bits``: bitmaps of the distinct lines, stations, hours, and of the batch's keys.

A batch is written under a partition ``batch=`` of its own in every table and then
published (``versions``): a reader sees all of a batch or nothing, and a batch
that failed is run again.
Batches come in the order of time; one that is not later than the last is
refused, as its windows would need rows that are gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridelens.operators import partials as P
from ridelens.operators import windows
from ridelens.sources import versions

#: rows before a row that its history features read
REACH = 7
STAT_KEYS = {"station": "string", "hour": "int", "line": "string"}
CODED = ("line", "station")


def carry_over(rows: DataFrame, reach: int = REACH, partition=windows.PARTITION, order=windows.ORDER) -> DataFrame:
    """The last ``reach`` rows of every history."""
    last = Window.partitionBy(*partition).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_back", F.row_number().over(last)).filter(F.col("_back") <= reach).drop("_back")


def append_history(carry: DataFrame | None, new: DataFrame) -> DataFrame:
    """The history features of ``new`` rows, which are all later than those of ``carry``."""
    if carry is None:
        return windows.with_history_features(new)
    both = carry.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    return windows.with_history_features(both).filter("_new").drop("_new")


class MonthlyTables:
    """State tables under ``path``: batches of (use_month, use_date, line, station, hour, total) are appended."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _published(self) -> list[str]:
        return [name for _, name in versions.published(self.spark, self.path)]

    def _read(self, name: str, batches: list[str]) -> DataFrame | None:
        root = f"{self.path}/{name}"
        return self.spark.read.option("basePath", root).parquet(*[f"{root}/batch={b}" for b in batches]).drop("batch") if batches else None

    def append(self, rows: DataFrame) -> str:
        """Adds a batch of months; returns its name. ``rows`` is read several times: a written table is best."""
        done = self._published()
        carry, codes = self._read("carry", done[-1:]), self._read("codes", done[-1:])
        rows = rows.select("use_month", "use_date", "line", "station", "hour", "total")
        if carry is not None:
            first, last = rows.agg(F.min("use_date")).first()[0], carry.agg(F.max("use_date")).first()[0]
            if first is not None and last is not None and first <= last:
                raise ValueError(f"months are appended in order: {first} is not after {last}")
        batch = versions.new_version("b")
        to = lambda name: f"{self.path}/{name}/batch={batch}"
        append_history(carry, rows).write.partitionBy("use_month").parquet(to("features"))
        carry_over(rows if carry is None else carry.unionByName(rows)).write.parquet(to("carry"))
        P.partial_stats(rows, STAT_KEYS).write.parquet(to("partials"))
        P.extend_codes(codes, rows, CODED).write.parquet(to("codes"))
        coded = P.with_codes(rows, self.spark.read.parquet(to("codes")), CODED)
        # null is no value of a distinct count (but one of a key): its code exists, so it is left out here
        code = {c: F.when(F.col(c).isNotNull(), F.col(f"{c}_idx")) for c in CODED}
        P.distinct_bits(coded, {**code, "hour": F.col("hour")}).write.parquet(to("bits"))
        versions.publish(self.spark, self.path, batch)
        return batch

    def features(self) -> DataFrame:
        return self._read("features", self._published())

    def stats(self) -> DataFrame:
        """What ``stats.group_stats`` gives over all appended rows."""
        return P.merge_stats(self._read("partials", self._published()), STAT_KEYS)

    def codes(self) -> DataFrame:
        return self._read("codes", self._published()[-1:])

    def distinct_counts(self) -> DataFrame:
        return P.count_bits(P.merge_bits(self._read("bits", self._published())), ["line", "station", "hour"])


def duplicate_count(df: DataFrame, keys, codes: DataFrame) -> DataFrame:
    """Rows beyond the first per (month, keys), by bitmaps: rows minus set bits. ``codes``: dictionary of the keys; the
    months are told apart by the bitmap rows' group, so a month's bitmaps merge with no other's."""
    sizes = {r["column_name"]: r["n"] for r in codes.groupBy("column_name").agg((F.max("code") + 1).alias("n")).collect()}
    coded = P.with_codes(df, codes, keys)
    key = P.dense_code([(F.col(f"{k}_idx"), sizes.get(k, 1)) for k in keys])
    rows = coded.select(F.coalesce(F.col("use_month").cast("string"), F.lit("none")).alias("name"), key.alias("code"))
    distinct = P._bits(rows, F.col("code"), ["name"])
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        (F.col("rows") - F.coalesce(distinct.agg(F.sum(F.bitmap_count("bits"))).scalar(), F.lit(0))).cast("long").alias("duplicate_rows"))
