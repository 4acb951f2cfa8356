"""Fixed schemas of the six raw trace tables and of the feature table.

Fixed values: column names, order and types must equal the trace format so
that headerless CSV files parse positionally. Unsigned 64-bit ids and
timestamps are held as signed longs (a value above 2^63-1 fails the load).
BOOLEAN columns are declared as strings here and cast after the scan, since
the CSV reader does not accept ``0``/``1`` for booleans.
"""

from __future__ import annotations

from pyspark.sql import types as T

L, I, D, S = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()
B = T.BooleanType()

# ---- fixed values: raw table layouts (name, logical type) -------------------
TASK_EVENTS = [
    ("timestamp", L), ("missing_info", L), ("job_id", L), ("task_index", L),
    ("machine_id", L), ("event_type", I), ("user_name", S),
    ("scheduling_class", I), ("priority", I), ("cpu_request", D),
    ("ram_request", D), ("disk_request", D),
    ("different_machine_constraint", B),
]
JOB_EVENTS = [
    ("timestamp", L), ("missing_info", L), ("job_id", L), ("event_type", I),
    ("user_name", S), ("scheduling_class", I), ("job_name", S),
    ("logical_job_name", S),
]
MACHINE_EVENTS = [
    ("timestamp", L), ("machine_id", L), ("event_type", I), ("platform_id", S),
    ("capacity_cpu", D), ("capacity_memory", D),
]
MACHINE_ATTRIBUTES = [
    ("timestamp", L), ("machine_id", L), ("attribute_name", S),
    ("attribute_value", S), ("attribute_deleted", B),
]
TASK_CONSTRAINTS = [
    ("timestamp", L), ("job_id", L), ("task_index", L), ("attribute_name", S),
    ("attribute_value", S), ("comparison_operator", I),
]
TASK_USAGE = [
    ("start_time", L), ("end_time", L), ("job_id", L), ("task_index", L),
    ("machine_id", L), ("mean_cpu_usage_rate", D), ("canonical_memory_usage", D),
    ("assigned_memory_usage", D), ("unmapped_page_cache_memory_usage", D),
    ("total_page_cache_memory_usage", D), ("maximum_memory_usage", D),
    ("mean_disk_io_time", D), ("mean_local_disk_space_used", D),
    ("maximum_cpu_usage", D), ("maximum_disk_io_time", D),
    ("cycles_per_instruction", D), ("memory_accesses_per_instruction", D),
    ("sample_portion", D), ("aggregation_type", I), ("sampled_cpu_usage", D),
]

RAW_TABLES: dict[str, list] = {
    "task_events": TASK_EVENTS,
    "job_events": JOB_EVENTS,
    "machine_events": MACHINE_EVENTS,
    "machine_attributes": MACHINE_ATTRIBUTES,
    "task_constraints": TASK_CONSTRAINTS,
    "task_usage": TASK_USAGE,
}

# ---- fixed values: feature table and model inputs ---------------------------
FEATURE_COLUMNS = [
    "job_id", "task_index", "submit_ts", "schedule_ts", "schedule_machine",
    "priority", "scheduling_class", "cpu_request", "ram_request",
    "disk_request", "different_machine_constraint", "has_missing_info",
    "job_task_count", "queue_delay_seconds", "submit_day", "submit_hour",
    "submit_minute", "machine_cpu_capacity", "machine_memory_capacity",
    "backlog_estimate", "submits_same_minute", "schedules_same_minute",
    "request_sum", "split",
]

MODEL_FEATURES = [
    "priority", "scheduling_class", "cpu_request", "ram_request",
    "disk_request", "request_sum", "different_machine_constraint",
    "has_missing_info", "submit_day", "submit_hour", "submit_minute",
    "backlog_estimate", "submits_same_minute", "schedules_same_minute",
    "job_task_count", "machine_cpu_capacity", "machine_memory_capacity",
]

LABEL = "queue_delay_seconds"
SPLITS = ("train", "valid", "test")

# Event codes used by the feature plan.
SUBMIT, SCHEDULE = 0, 1
VALID_EVENT_TYPES = (0, 8)          # inclusive range
VALID_AGGREGATION_TYPES = (0, 1)


def scan_schema(columns: list) -> T.StructType:
    """Schema handed to the CSV reader (booleans read as strings)."""
    return T.StructType(
        [T.StructField(name, S if dtype == B else dtype, True) for name, dtype in columns]
    )


def boolean_columns(columns: list) -> list[str]:
    return [name for name, dtype in columns if dtype == B]
