"""Per-task feature table.

Plan shape (task_events is read three times, each scan pruned to its columns
and, for the counts, filtered at the scan):

  task_events --(agg by job_id, task_index; map-side partial)--> task_rollup
      one fused conditional aggregation gives first SUBMIT, first SCHEDULE and
      its machine, the earliest non-NULL attributes and the two flags; it
      replaces three scans, three shuffles and two joins of the naive plan.
  SUBMIT events --(distinct tasks, then count by job_id)--> job_task_counts
  task_events --(agg by minute)--> minute_events --(block prefix sum)--> backlog
  machine_events --(agg by machine)--> machine_capacity  (latest non-NULL)

  base = task_rollup filtered to tasks with both stamps, in order
  base LEFT JOIN job_task_counts  ON job_id
       LEFT JOIN machine_capacity ON schedule_machine
       LEFT JOIN backlog          ON minute bucket of submit_ts

All three right sides are aggregates and are joined only when one of their
columns is asked for: broadcast from a (size-bounded) estimate or AQE's
measured size, else a sort-merge join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.functions.split import split_label
from queuelens.functions.time import (
    MINUTES_PER_DAY, day_index, hour_index, minute_bucket, minute_index, seconds_between,
)
from queuelens.operators.first_value import first_by, last_by
from queuelens.operators.prefix_sum import running_sum
from queuelens.sources.schemas import FEATURE_COLUMNS, SCHEDULE, SUBMIT

KEYS = ["job_id", "task_index"]


def minute_events(task_events: DataFrame) -> DataFrame:
    """A1: SUBMIT and SCHEDULE event counts per minute bucket."""
    et = F.col("event_type")
    return (
        task_events.where(et.isin(SUBMIT, SCHEDULE))
        .groupBy(minute_bucket(F.col("timestamp")).alias("minute_bucket"))
        .agg(
            F.count(F.when(et == SUBMIT, 1)).alias("submits"),
            F.count(F.when(et == SCHEDULE, 1)).alias("schedules"),
        )
    )


def backlog(task_events: DataFrame) -> DataFrame:
    """Running ``submits - schedules`` over minutes (may go negative)."""
    m = minute_events(task_events).withColumn(
        "net", F.col("submits") - F.col("schedules")
    )
    return running_sum(m, "minute_bucket", "net", "pending_estimate", MINUTES_PER_DAY).drop("net")


def task_rollup(task_events: DataFrame) -> DataFrame:
    """A2-A5 fused: one row per (job_id, task_index), NULL keys kept as groups."""
    ts, et = F.col("timestamp"), F.col("event_type")
    is_submit, is_schedule = et == SUBMIT, et == SCHEDULE
    return task_events.groupBy(*KEYS).agg(
        F.count(F.when(is_submit, 1)).alias("submit_events"),
        F.count(F.when(is_schedule, 1)).alias("schedule_events"),
        F.min(F.when(is_submit, ts)).alias("submit_ts"),
        F.min(F.when(is_schedule, ts)).alias("schedule_ts"),
        first_by(F.col("machine_id"), ts, is_schedule).alias("schedule_machine"),
        first_by(F.col("priority"), ts).alias("priority"),
        first_by(F.col("scheduling_class"), ts).alias("scheduling_class"),
        first_by(F.col("cpu_request"), ts).alias("cpu_request"),
        first_by(F.col("ram_request"), ts).alias("ram_request"),
        first_by(F.col("disk_request"), ts).alias("disk_request"),
        F.max(F.when(F.col("different_machine_constraint"), 1).otherwise(0))
        .alias("different_machine_constraint"),
        F.max(F.when(F.col("missing_info").isNotNull(), 1).otherwise(0))
        .alias("has_missing_info"),
    )


def first_submit(task_events: DataFrame) -> DataFrame:
    """A2 alone: first SUBMIT per task."""
    return (
        task_events.where(F.col("event_type") == SUBMIT)
        .groupBy(*KEYS).agg(F.min("timestamp").alias("submit_ts"))
    )


def first_schedule(task_events: DataFrame) -> DataFrame:
    """A3 alone: first SCHEDULE per task and the machine of that event."""
    ts = F.col("timestamp")
    return (
        task_events.where(F.col("event_type") == SCHEDULE)
        .groupBy(*KEYS)
        .agg(F.min(ts).alias("schedule_ts"), first_by(F.col("machine_id"), ts).alias("schedule_machine"))
    )


def job_task_counts(task_events: DataFrame) -> DataFrame:
    """Tasks with at least one SUBMIT event, per job.

    Reads only SUBMIT events (the filter reaches the scan), collapses them to
    distinct tasks and counts per job; both steps aggregate map-side first,
    so a job with a huge number of tasks is pre-counted in every task.
    """
    return (
        task_events.where(F.col("event_type") == SUBMIT)
        .select("job_id", "task_index").distinct()
        .groupBy("job_id").agg(F.count(F.lit(1)).alias("job_task_count"))
    )


def machine_capacity(machine_events: DataFrame) -> DataFrame:
    """Latest non-NULL CPU and memory capacity per machine."""
    ts = F.col("timestamp")
    return machine_events.groupBy("machine_id").agg(
        last_by(F.col("capacity_cpu"), ts).alias("capacity_cpu"),
        last_by(F.col("capacity_memory"), ts).alias("capacity_memory"),
    )


def submit_schedule_pairs(rollup: DataFrame) -> DataFrame:
    """Tasks with at least one SUBMIT and one SCHEDULE (non-NULL keys)."""
    return rollup.where(
        F.col("job_id").isNotNull() & F.col("task_index").isNotNull()
        & (F.col("submit_events") > 0) & (F.col("schedule_events") > 0)
    )


def feature_base(rollup: DataFrame) -> DataFrame:
    """Tasks with a SUBMIT and a SCHEDULE, scheduled no earlier."""
    sub, sch = F.col("submit_ts"), F.col("schedule_ts")
    return rollup.where(
        F.col("job_id").isNotNull() & F.col("task_index").isNotNull()
        & sub.isNotNull() & sch.isNotNull() & (sch >= sub)
    )


# Columns that each side of the joins gives.
_SIDES = {
    "counts": {"job_task_count"},
    "capacity": {"machine_cpu_capacity", "machine_memory_capacity"},
    "load": {"backlog_estimate", "submits_same_minute", "schedules_same_minute"},
}


def build_features(task_events: DataFrame, machine_events: DataFrame,
                   columns: list[str] | None = None) -> DataFrame:
    """The 24-column feature table, one row per schedulable task, or the named
    ``columns`` of it; a side is joined only when one of its columns is asked
    for. The plan is lazy: building it starts no job.

    The per-minute side has one row per minute of the trace's span. AQE
    broadcasts each side from its measured size, else joins by key.
    """
    columns = list(columns or FEATURE_COLUMNS)
    joined = feature_base(task_rollup(task_events)).withColumn("submit_bucket", minute_bucket(F.col("submit_ts")))
    if _SIDES["counts"] & set(columns):
        joined = joined.join(job_task_counts(task_events), "job_id", "left")
    if _SIDES["capacity"] & set(columns):
        capacity = machine_capacity(machine_events).withColumnRenamed("machine_id", "schedule_machine")
        joined = joined.join(capacity, "schedule_machine", "left")
    if _SIDES["load"] & set(columns):
        load = backlog(task_events).withColumnRenamed("minute_bucket", "submit_bucket")
        joined = joined.join(load, "submit_bucket", "left")
    sub = F.col("submit_ts")
    cpu = F.coalesce(F.col("cpu_request"), F.lit(0.0))
    ram = F.coalesce(F.col("ram_request"), F.lit(0.0))
    disk = F.coalesce(F.col("disk_request"), F.lit(0.0))

    def count(name: str):
        return F.coalesce(name, F.lit(0).cast("bigint"))

    made = {
        "cpu_request": lambda: cpu, "ram_request": lambda: ram, "disk_request": lambda: disk,
        "different_machine_constraint": lambda: F.coalesce("different_machine_constraint", F.lit(0)),
        "has_missing_info": lambda: F.coalesce("has_missing_info", F.lit(0)),
        "job_task_count": lambda: count("job_task_count"),
        "queue_delay_seconds": lambda: seconds_between(sub, F.col("schedule_ts")),
        "submit_day": lambda: day_index(sub),
        "submit_hour": lambda: hour_index(sub),
        "submit_minute": lambda: minute_index(sub),
        "machine_cpu_capacity": lambda: F.coalesce("capacity_cpu", F.lit(0.0)),
        "machine_memory_capacity": lambda: F.coalesce("capacity_memory", F.lit(0.0)),
        "backlog_estimate": lambda: count("pending_estimate"),
        "submits_same_minute": lambda: count("submits"),
        "schedules_same_minute": lambda: count("schedules"),
        "request_sum": lambda: cpu + ram + disk,
        "split": lambda: split_label(F.col("job_id")),
    }
    return joined.select(*[(made[c]() if c in made else F.col(c)).alias(c) for c in columns])


def feature_summary(features: DataFrame) -> DataFrame:
    """Rows and mean delay per split."""
    return (
        features.groupBy("split")
        .agg(F.count(F.lit(1)).alias("rows"), F.avg("queue_delay_seconds").alias("avg_queue_delay"))
        .orderBy("split")
    )
