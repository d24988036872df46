"""Live arrivals as a Structured Streaming job.

Flattening an arrival payload is stateless and row-local, so the batch
operator runs unchanged on a stream: source files -> payload rows ->
``flatten_arrivals`` -> a parquet sink. The stream's checkpoint lives in
the session's checkpoint folder (shared storage on a cluster), so a restarted
or failed-over query resumes exactly where it stopped; the sink is
idempotent per micro-batch, which gives exactly-once output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ridelens.session import scratch_path
from ridelens.sources.fixtures import payload_texts
from ridelens.sources.payloads import flatten_arrivals


def events_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The driver's events table read as a file stream (new files in the
    folder matching events*.parquet become new micro-batches)."""
    schema = spark.read.option("pathGlobFilter", "events*.parquet").parquet(sf_dir).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(sf_dir)


def arrivals_from_stream(events: DataFrame) -> DataFrame:
    payloads = payload_texts(events).selectExpr("event_id", "arrivals_json AS payload")
    return flatten_arrivals(payloads)


def run_available_now(stream: DataFrame, sink_path: str, checkpoint_path: str) -> None:
    """Process everything available, then stop (a scheduled incremental run). It waits without limit:
    deadlines belong to the scheduler."""
    q = (
        stream.writeStream.format("parquet")
        .option("path", sink_path)
        .option("checkpointLocation", checkpoint_path)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()  # raises what ended the query


def arrivals_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run the arrivals stream to completion and return its sink table."""
    base = scratch_path(spark, "arrivals")
    run_available_now(arrivals_from_stream(events_stream(spark, sf_dir)), f"{base}/sink", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/sink")
