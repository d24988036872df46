"""Sharding by a Hilbert curve over quantised metadata.

Each dimension is quantised to a few bits, the cell's index on the Hilbert
curve orders the rows, and the order is cut into runs of equal row counts. A
run is a connected stretch of the curve, so its bounding box is small in every
dimension and a shard's min/max prune files for filters on any of them.

DataFrame functions only. The global rank comes from a range exchange (which
also splits a crowded cell, since the order goes on with the text's CRC and the
id), the row number inside each range and the row counts of the ranges before:
no task ever holds more than one range. Only keys are moved, never texts.

Defined cases: a null text has no bytes (size 16, CRC 0); null metadata have
a cell of their own hash; equal rows are ranked in any order, each with its own
slot; an empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelens.llm.common import stage

RECORD_BYTES = 16
BITS = 5


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """For state * 2**dims + cell bits: the curve digit, and the next state. A state is the
    entry corner and the axis of the current sub-cube; digits follow the Gray code."""
    full = (1 << dims) - 1
    rotate = lambda x, k: ((x << (k % dims)) | (x >> (dims - k % dims))) & full
    digits, following = [], []
    for state in range(dims << dims):
        corner, axis = state % (full + 1), state // (full + 1)
        for cell in range(full + 1):
            code = rotate(cell ^ corner, dims - (axis + 1) % dims)
            digit = 0
            while code:
                digit, code = digit ^ code, code >> 1
            enter = 0 if digit == 0 else (2 * ((digit - 1) // 2)) ^ (((digit - 1) // 2))
            flips = digit if digit % 2 else digit - 1
            turn = 0 if digit == 0 else (~flips & (flips + 1)).bit_length() - 1
            digits.append(digit)
            following.append((corner ^ rotate(enter, axis + 1)) + ((axis + turn % dims + 1) % dims) * (full + 1))
    return digits, following


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Curve index of a cell given by one integer column of ``bits`` bits per dimension."""
    digits, following = curve_tables(len(cells))
    lookup = lambda t, at: F.element_at(F.array(*[F.lit(x) for x in t]), at + 1)

    def step(state: Column, bit: Column) -> Column:
        cell = F.lit(0)
        for j, c in enumerate(cells):
            cell = cell + F.call_function("shiftright", c, bit).bitwiseAND(F.lit(1)) * F.lit(1 << j)
        at = state["s"] * F.lit(1 << len(cells)) + cell
        return F.struct(lookup(following, at).alias("s"), (state["h"] * F.lit(1 << len(cells)) + lookup(digits, at)).cast("long").alias("h"))

    start = F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("h"))
    return F.aggregate(F.array(*[F.lit(b) for b in range(bits - 1, -1, -1)]), start, step, lambda s: s["h"])


def by_hash(c: Column, bits: int = BITS) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(1 << bits)).cast("int")


def by_magnitude(c: Column, bits: int = BITS) -> Column:
    """Half-octave steps of a count."""
    return F.least(F.floor(2 * F.log2(F.greatest(c, F.lit(1)))), F.lit((1 << bits) - 1)).cast("int")


def global_rank(keys: DataFrame, order: list[str], rank: str = "rank", total: str = "total") -> DataFrame:
    """0-based rank of each row in the order and the row count, by a range exchange. Only the count per range
    is gathered, one row each, so the broadcast side has as many rows as there are shuffle partitions."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keys.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = stage(ranged.withColumns({"_range": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "ranges")
    sizes = ranged.groupBy("_range").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                         F.sum("_n").over(Window.partitionBy()).alias(total))
    out = ranged.join(F.broadcast(sizes), "_range")
    return out.withColumn(rank, F.col("_before") + F.col("_row") - F.col("_first")).drop("_range", "_row", "_first", "_before")


def hilbert_shards(docs: DataFrame, shards: int, dims: Mapping[str, Column] | None = None, bits: int = BITS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id, size, CRC, quantised dimensions (``dim_*``), curve index, ``shard`` and ``slot``.
    Shards' row counts differ by one at most; slots of a shard run from 0 without gaps."""
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + RECORD_BYTES
    dims = dims or {"lang": by_hash(F.col("lang"), bits), "source": by_hash(F.col("source"), bits), "size": by_magnitude(size, bits)}
    named = {f"dim_{k}": c for k, c in dims.items()}
    crc = F.coalesce(F.crc32(F.encode(F.col(text_col), "UTF-8")), F.lit(0)).cast("long")
    keys = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), *[c.alias(k) for k, c in named.items()])
    keys = stage(keys.withColumn("hilbert", hilbert_index([F.col(k) for k in named], bits)), "cells")
    out = global_rank(keys, ["hilbert", "text_crc32", "doc_id"])
    out = out.withColumn("shard", F.expr(f"rank * {shards} div total").cast("int"))
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")  # rank of the shard's first row
    return out.withColumn("slot", F.col("rank") - first).drop("rank", "total")


def manifest(assigned: DataFrame) -> DataFrame:
    """One row per shard with rows, bytes and the range of each dimension: what a reader prunes by."""
    dims = [c for c in assigned.columns if c.startswith("dim_")]
    return assigned.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"),
                                         *[f(c).alias(f"{f.__name__}_{c}") for c in dims for f in (F.min, F.max)])


def shards_for(listing: DataFrame, **wanted: int) -> DataFrame:
    """The shards whose ranges may hold the wanted cell of each named dimension."""
    for k, v in wanted.items():
        listing = listing.filter((F.col(f"min_dim_{k}") <= v) & (F.col(f"max_dim_{k}") >= v))
    return listing.select("shard")


def write_shards(rows: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes ``rows`` as one folder of Parquet files per shard (rows joined by id, sorted along the curve)."""
    side = assigned.select(F.col("doc_id").alias("_id"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    out = rows.join(side, F.col(id_col).eqNullSafe(F.col("_id"))).drop("_id")
    out.repartition("_shard").sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)
