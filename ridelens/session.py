"""Session helpers.

On a cluster the session comes from the platform; the library only reads its
settings. ``local_session`` is for tests and the bench: it sets what a laptop
needs (few shuffle partitions, UTC, no UI) and a checkpoint folder only when
the session has none.
"""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ridelens") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, creating a local one only if unset.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that one is
    always used as is. The local fallback exists for tests only.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: name a shared folder for stage checkpoints")
    local = tempfile.mkdtemp(prefix="ridelens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return local


_stages: list[str] = []


def checkpoint_stage(df, name: str = "stage", partition_by=None):
    """Materialise a stage table in the session's checkpoint folder and cut
    its lineage.

    The table is WRITTEN as parquet and read back: it is computed exactly
    once (an eager ``checkpoint()`` of an unpersisted DataFrame computes it
    twice, once to count and once to write), it lives in shared storage so
    it survives the loss of executors, and later reads get column pruning
    and predicate pushdown (and partition pruning with ``partition_by``)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(schema).parquet(path).select(*df.columns)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the checkpoint folder, removed with the stage tables of a ``stage_scope``."""
    import uuid

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _stages.append(path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def stage_scope(spark: SparkSession):
    """Removes, at its end, the stage tables written inside it. Results must be written or collected within;
    the caller decides, since a stage table is needed as long as a DataFrame reads it."""
    first = len(_stages)
    try:
        yield
    finally:
        for path in _stages[first:]:
            remove_path(spark, path)
        del _stages[first:]
