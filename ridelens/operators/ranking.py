"""Exact rank of each row inside its group, without a per-group task.

``row_number() over (partition by label order by k)`` sends every row of a
label to one task; with four labels and one of them holding a third of the
data that task holds a third of the data. Instead:

1. range-partition by (group, order keys) and sort inside each partition:
   a big group is spread over many partitions, each partition is sorted;
2. number the rows of each partition (``monotonically_increasing_id`` is
   consecutive inside a partition) and checkpoint, so the numbers are
   stable even if an executor is lost and a partition is recomputed;
3. count rows per (partition, group) - a table of partitions x groups rows -
   and turn the counts into offsets with a window per group over that small
   table; broadcast it back and add.

The order keys must be a total order (append a unique key). The same path
runs at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelens.session import checkpoint_stage


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


HASH_BITS = 60


def key_hash(key_cols, seed: int = 42) -> Column:
    """The first 60 bits of the MD5 of the seed and the key's texts: an order that other engines can repeat."""
    parts = [F.coalesce(c.cast("string"), F.lit("null")) for c in _cols(key_cols)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def hash_order(key_cols, seed: int = 42) -> list[Column]:
    """A seeded pseudo-random but reproducible total order: the hash of the
    key, then the key itself to break hash ties."""
    return [key_hash(key_cols, seed)] + _cols(key_cols)


def rank_within(df: DataFrame, group_col: str | None, order_cols, rank_col: str = "rank_in_group",
                size_col: str = "group_size", num_partitions: int | None = None) -> DataFrame:
    """Adds the 1-based rank of each row in its group (``group_col`` None
    means one group) and the group size."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    g = F.col(group_col) if group_col else F.lit(0)
    base = df.withColumn("_g", g)
    keys = [F.col("_g")] + _cols(order_cols)
    ranged = (
        base.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    ranged = checkpoint_stage(ranged)
    per = ranged.groupBy("_pid", "_g").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy("_g").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({
        "_before": F.coalesce(F.sum("_cnt").over(before), F.lit(0)),
        size_col: F.sum("_cnt").over(Window.partitionBy("_g")),
    })
    per = per.withColumnRenamed("_pid", "_p2").withColumnRenamed("_g", "_g2")
    out = ranged.join(per, (F.col("_pid") == F.col("_p2")) & F.col("_g").eqNullSafe(F.col("_g2")), "left")
    out = out.withColumn(rank_col, (F.col("_before") + F.col("_mid") - F.col("_first") + 1).cast("long"))
    return out.drop("_g", "_pid", "_mid", "_p2", "_g2", "_first", "_cnt", "_before")


def select_first(df: DataFrame, group_col: str | None, key_cols, quota, seed: int = 42, flag_col: str = "selected",
                 bucket_bits: int = 16) -> DataFrame:
    """Flags, per group, the first ``quota`` rows in the seeded hash order of
    the key, exactly, without shuffling or rewriting the table.

    ``quota`` maps the group-size column to the wanted count (a Column
    expression). The 60-bit hash is cut into 2^bucket_bits ordered buckets;
    one aggregate (pre-aggregated on every task) counts rows per (group,
    bucket); running sums over that small table mark every bucket as wholly
    in or wholly out, except one boundary bucket per group, whose rows (about
    1 / 2^bucket_bits of the group) are numbered in their order."""
    keys = _cols(key_cols)
    g = F.col(group_col) if group_col else F.lit(0)
    base = df.withColumns({"_sf_g": g, "_sf_h": key_hash(key_cols, seed)})
    base = base.withColumn("_sf_b", F.shiftright("_sf_h", HASH_BITS - bucket_bits))  # order-preserving bucket
    counts = base.groupBy("_sf_g", "_sf_b").agg(F.count(F.lit(1)).alias("_sf_c"))
    w = Window.partitionBy("_sf_g").orderBy("_sf_b")
    counts = counts.withColumns({
        "_sf_before": F.coalesce(F.sum("_sf_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_sf_n": F.sum("_sf_c").over(Window.partitionBy("_sf_g")),
    })
    counts = counts.withColumn("_sf_m", quota(F.col("_sf_n")).cast("long"))
    status = (
        F.when(F.col("_sf_before") + F.col("_sf_c") <= F.col("_sf_m"), F.lit("all"))
        .when(F.col("_sf_before") >= F.col("_sf_m"), F.lit("none"))
        .otherwise(F.lit("partial"))
    )
    table = counts.select(F.col("_sf_g").alias("_sf_g2"), F.col("_sf_b").alias("_sf_b2"), status.alias("_sf_st"),
                          (F.col("_sf_m") - F.col("_sf_before")).alias("_sf_need"), F.col("_sf_c").alias("_sf_bc"))
    joined = base.join(table, F.col("_sf_g").eqNullSafe(F.col("_sf_g2")) & (F.col("_sf_b") == F.col("_sf_b2")), "left")
    rest = joined.filter(F.col("_sf_st") != "partial").withColumn(flag_col, F.col("_sf_st") == "all")
    w = Window.partitionBy("_sf_g", "_sf_b").orderBy(F.col("_sf_h"), *keys)
    part = joined.filter(F.col("_sf_st") == "partial").withColumn(flag_col, F.row_number().over(w) <= F.col("_sf_need"))
    return rest.unionByName(part).drop("_sf_g", "_sf_h", "_sf_b", "_sf_g2", "_sf_b2", "_sf_st", "_sf_need", "_sf_bc")
