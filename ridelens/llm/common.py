"""What several operators share: written stages, row-wise Arrow steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelens.session import checkpoint_stage


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to the session's checkpoint folder and read back: computed once, no lineage, survives lost executors."""
    return checkpoint_stage(df, name)


def with_columns_arrow(df: DataFrame, column: str, added: T.StructType, make: Callable[[pa.Array], dict[str, pa.Array]]) -> DataFrame:
    """``df`` with the columns of ``added``, which ``make`` computes from one column of each Arrow batch.
    An input column that has the name of an added one is replaced."""
    names = {f.name.lower() for f in added}
    hidden = "_in_" + column
    base = df.select(F.col(f"`{column}`").alias(hidden), *[F.col(f"`{c}`") for c in df.columns if c.lower() not in names])
    schema = T.StructType([f for f in base.schema if f.name != hidden] + list(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            made = make(batch.column(0))
            yield pa.RecordBatch.from_arrays(batch.columns[1:] + [made[f.name] for f in added], names=batch.schema.names[1:] + [f.name for f in added])

    return base.mapInArrow(run, schema)
