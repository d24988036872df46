"""Groups of rows as blocks of bounded size: a large group becomes chunks, and every two chunks a block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.llm.textnum import release


def with_blocks(rows: DataFrame, group: list[str], sizes: DataFrame, chunks: Column, key: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with the groups' ``sizes`` (``how`` left: those not listed have one chunk), repeated once per
    block: ``_lo`` and ``_hi`` name its chunks.
    A group of one chunk is one block; with n chunks, each row is in the n - 1 blocks that pair its chunk with
    another. Any two rows of a group meet in some block."""
    out = rows.join(sizes, group, how).withColumn("_n", F.coalesce(chunks, F.lit(1)).cast("long")).withColumn("_c", F.pmod(F.xxhash64(key), F.col("_n")))
    others = F.when(F.col("_n") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.array_except(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), F.array("_c")))
    out = out.withColumn("_o", F.explode(others))
    return out.withColumns({"_lo": F.least("_c", "_o"), "_hi": F.greatest("_c", "_o")}).drop("_n", "_c", "_o")


def map_blocks(rows: DataFrame, keys: list[str], make: Callable[[list[pa.Table]], pa.Table], schema: str, goal: Callable[[pa.Table], int], most: int) -> DataFrame:
    """Hands whole blocks (runs of equal keys) to ``make``, several at once up to ``most`` by ``goal``."""
    held = [F.col(k) for k in keys]
    block = F.xxhash64(*held)
    cols = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[pa.Table] = []
        size = 0
        pending: list[pa.Table] = []  # the block that may go on in the next batch
        last = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            ids = list(zip(*[table.column(k).to_pylist() for k in keys]))
            at = 0
            for i in range(1, len(ids) + 1):
                if i == len(ids) or ids[i] != ids[at]:
                    if pending and ids[at] != last:
                        done = pa.concat_tables(pending)
                        ready.append(done)
                        size += goal(done)
                        pending = []
                        if size >= most:
                            yield from make(ready).to_batches()
                            ready, size = [], 0
                    pending.append(table.slice(at, i - at))
                    last, at = ids[at], i
        if pending:
            ready.append(pa.concat_tables(pending))
        if ready:
            yield from make(ready).to_batches()
        release()

    dealt = rows.withColumn("_block", block).repartition("_block").sortWithinPartitions("_block", *keys)
    return dealt.select(*cols).mapInArrow(run, schema)
