import os
import shutil
import tempfile

from ridelens.sources import fixtures as V
from ridelens.sources.payloads import flatten_arrivals
from ridelens.streaming.arrivals import arrivals_from_stream, events_stream, run_available_now

SF = "/root/testdata/sf0.001"


def test_arrivals_stream_equals_batch_and_is_incremental(spark):
    # the stream source is a folder; copy the events file in twice to see two incremental runs
    src = tempfile.mkdtemp(prefix="ridelens-stream-src-")
    base = tempfile.mkdtemp(prefix="ridelens-stream-")
    shutil.copy(f"{SF}/events.parquet", f"{src}/events-1.parquet")
    stream = arrivals_from_stream(events_stream(spark, src))
    run_available_now(stream, f"{base}/sink", f"{base}/ckpt")
    first = spark.read.parquet(f"{base}/sink").count()
    batch = flatten_arrivals(V.v_json(spark, SF).selectExpr("event_id", "arrivals_json AS payload"))
    assert first == batch.count()
    a = sorted(tuple(r) for r in spark.read.parquet(f"{base}/sink").collect())
    b = sorted(tuple(r) for r in batch.select(*spark.read.parquet(f"{base}/sink").columns).collect())
    assert a == b
    # a restart with the same checkpoint processes only the new file
    shutil.copy(f"{SF}/events.parquet", f"{src}/events-2.parquet")
    run_available_now(arrivals_from_stream(events_stream(spark, src)), f"{base}/sink", f"{base}/ckpt")
    assert spark.read.parquet(f"{base}/sink").count() == 2 * first
    assert os.path.isdir(f"{base}/ckpt/offsets")
