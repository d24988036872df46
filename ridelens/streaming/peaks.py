"""Peak-relative congestion over a stream of landed hourly responses.

Every response arrives whole in one row, so its peak is the maximum of an
array: flatten, peak and share are row-local. There is no window, no shuffle
and no state, and the native append sink gives exactly-once output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ridelens.operators.peak import response_peaks
from ridelens.session import scratch_path
from ridelens.sources.fixtures import payload_texts
from ridelens.streaming.arrivals import events_stream, run_available_now


def peaks_from_stream(events: DataFrame) -> DataFrame:
    return response_peaks(payload_texts(events).selectExpr("event_id", "hourly_json AS payload"))


def peak_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_path(spark, "peaks")
    run_available_now(peaks_from_stream(events_stream(spark, sf_dir)), f"{base}/sink", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/sink")
