"""Per-minute SUBMIT/SCHEDULE counts (A1) from a stream of task events.

The stream itself is stateless: each micro-batch appends the minute and kind of
its events to a Parquet table (exactly once, by the file sink's log), in
whatever order they come. Counts are a batch aggregation of that table, so a
late event counts like any other and no state or driver memory grows with the
stream. Offsets and the table lie under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.functions.time import minute_bucket
from queuelens.session import scratch_path
from queuelens.sources.schemas import SCHEDULE, SUBMIT


def minute_marks(events: DataFrame) -> DataFrame:
    """Streaming or batch task events -> (minute_bucket, event_type) of SUBMIT and SCHEDULE."""
    return events.where(F.col("event_type").isin(SUBMIT, SCHEDULE)).select(
        minute_bucket(F.col("timestamp")).alias("minute_bucket"), "event_type")


def append_marks(spark: SparkSession, events: DataFrame, path: str | None = None) -> str:
    """Drain the available input of a stream into the table at ``path``."""
    path = path or scratch_path(spark, f"minutes-{uuid.uuid4().hex}")
    query = (minute_marks(events).writeStream.format("parquet").outputMode("append")
             .option("path", path).option("checkpointLocation", f"{path}-offsets")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return path


def minute_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts per minute of everything appended so far."""
    et = F.col("event_type")
    marks = spark.read.schema("minute_bucket long, event_type int").parquet(path)
    return marks.groupBy("minute_bucket").agg(F.count(F.when(et == SUBMIT, 1)).alias("submits"),
                                              F.count(F.when(et == SCHEDULE, 1)).alias("schedules"))
