"""Statistics that merge: what one batch of months adds, kept apart, and what all batches say together.

* ``partial_stats`` / ``merge_stats``: per grouping key and value the sum, count,
  maximum and minimum of a batch; merged by an aggregate over these small
  tables, they give the same table as ``stats.group_stats`` over all rows.
* ``extend_codes``: an append-only dictionary of label codes: values seen for
  the first time get the next numbers, in code-point order; numbers given once
  never change. (``encode.label_codes`` numbers all values in order instead.)
* ``distinct_bits`` / ``merge_bits`` / ``count_bits``: exact distinct counts as
  bitmaps over dense codes, 32,768 codes a row of 4 KB. Bitmaps of batches merge
  by OR; a distinct count is a sum of set bits. One scan, no copy of the rows
  per column, and duplicates of a key are rows minus set bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelens.operators.encode import _as_text

#: bits of one row of a bitmap table
BITS = 32768


def partial_stats(df: DataFrame, keys, value_col: str = "total") -> DataFrame:
    """(_set, value, s, n, hi, lo): per grouping key (named by ``_set``) and value (as text; null is a value of its own)
    the sum of ``value_col``, the number of values that are not null and of rows, the largest and the smallest."""
    pairs = F.array(*[F.struct(F.lit(k).alias("_set"), F.col(k).cast("string").alias("value")) for k in keys])
    v = F.col("_value")
    return df.select(F.col(value_col).alias("_value"), F.inline(pairs)).groupBy("_set", "value").agg(
        F.sum(v).alias("s"), F.count(v).alias("n"), F.max(v).alias("hi"), F.min(v).alias("lo"), F.count(F.lit(1)).alias("rows"))


def merge_stats(partials: DataFrame, types: dict[str, str]) -> DataFrame:
    """The table that ``stats.group_stats`` computes over all rows, from the partials of all batches. ``types``: grouping
    key -> its SQL type."""
    all_ = partials.groupBy("_set", "value").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("hi").alias("_max"), F.min("lo").alias("_min"), F.sum("rows").alias("_n"))
    keys = {k: F.when(F.col("_set") == k, F.col("value")).cast(t) for k, t in types.items()}
    return all_.select(*[c.alias(k) for k, c in keys.items()], F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("_avg"), "_max", "_min", "_n", "_set")


def extend_codes(codes: DataFrame | None, df: DataFrame, columns) -> DataFrame:
    """(column_name, value, code) of every value in ``codes`` or ``df``: old codes as they are, new values after them."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), _as_text(c).alias("value")) for c in columns])
    seen = df.select(F.inline(pairs)).distinct()
    order = Window.partitionBy("column_name").orderBy("value")  # a column's new values: bounded by its domain
    if codes is None:
        return seen.withColumn("code", (F.row_number().over(order) - 1).cast("int"))
    new = seen.join(codes, ["column_name", "value"], "left_anti")
    last = codes.groupBy("column_name").agg(F.max("code").alias("last"))
    new = new.join(last, "column_name", "left")
    code = F.row_number().over(order) + F.coalesce("last", F.lit(-1))
    return codes.select("column_name", "value", "code").unionByName(new.select("column_name", "value", code.cast("int").alias("code")))


def with_codes(df: DataFrame, codes: DataFrame, columns, suffix: str = "_idx") -> DataFrame:
    """``df`` with the code of every listed column."""
    out = df
    for c in columns:
        side = codes.filter(F.col("column_name") == c).select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"{c}{suffix}"))
        out = out.join(side, _as_text(c) == F.col(f"_v_{c}"), "left").drop(f"_v_{c}")
    return out


def _bits(df: DataFrame, key: Column, group) -> DataFrame:
    row = F.floor(key / BITS).cast("long").alias("row")
    return df.filter(key.isNotNull()).groupBy(*group, row).agg(F.bitmap_construct_agg((key % BITS).cast("long")).alias("bits"))


def distinct_bits(df: DataFrame, code_cols: dict[str, Column]) -> DataFrame:
    """(name, row, bits): for every named code (a whole number from 0; null is left out) the bitmap of its values."""
    pairs = F.array(*[F.struct(F.lit(k).alias("name"), c.cast("long").alias("code")) for k, c in code_cols.items()])
    return _bits(df.select(F.inline(pairs)), F.col("code"), ["name"])


def merge_bits(bitmaps: DataFrame) -> DataFrame:
    return bitmaps.groupBy("name", "row").agg(F.bitmap_or_agg("bits").alias("bits"))


def count_bits(bitmaps: DataFrame, names) -> DataFrame:
    """One row: ``n_<name>``, the number of distinct codes."""
    one = [F.coalesce(F.sum(F.when(F.col("name") == k, F.bitmap_count("bits"))), F.lit(0)).cast("long").alias(f"n_{k}") for k in names]
    return bitmaps.agg(*one)


def dense_code(codes: list[tuple[Column, int]]) -> Column:
    """One whole number for several codes, each below its bound."""
    return reduce(lambda a, b: a * F.lit(b[1]).cast("long") + b[0].cast("long"), codes[1:], codes[0][0].cast("long"))
