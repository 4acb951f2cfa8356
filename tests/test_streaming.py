"""Per-minute counts of a stream equal the batch operator, whatever the order of its files."""

import tempfile

from conftest import SF_SMALL
from queuelens.plans import features as FP
from queuelens.sources.adapters import adapter_frames, adapter_stream
from queuelens.streaming.minute_counts import append_marks, minute_counts


def test_stream_equals_batch(spark):
    streamed = minute_counts(spark, append_marks(spark, adapter_stream(spark, SF_SMALL, "task_events")))
    batch = FP.minute_events(adapter_frames(spark, SF_SMALL, ["task_events"])["task_events"])
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_late_and_out_of_order_files(spark):
    events = adapter_frames(spark, SF_SMALL, ["task_events"])["task_events"].select("timestamp", "event_type")
    folder = tempfile.mkdtemp(prefix="ql-stream-")
    events.orderBy(events["timestamp"].desc()).coalesce(1).write.option("maxRecordsPerFile", 2000).parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    path = append_marks(spark, stream)
    assert sorted(map(tuple, minute_counts(spark, path).collect())) == sorted(
        map(tuple, FP.minute_events(events).collect()))
