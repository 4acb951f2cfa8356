"""Raw-table sanity checks.

Every statistic is an aggregate with map-side partial results, so a scan of
a raw table ends in one small row set. The per-task statistics are fused:
one shuffle on (job_id, task_index) yields the row stats and the distinct
task count, and distinct jobs come from the task-level rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.session import scratch_path
from queuelens.sources.schemas import VALID_AGGREGATION_TYPES, VALID_EVENT_TYPES
from queuelens.sources.staged import footer_row

# Order of the row-count report (fixed).
ROW_COUNT_TABLES = ["task_events", "job_events", "task_constraints", "machine_events",
                    "machine_attributes", "task_usage"]


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """A9 + U1: one row per raw table."""
    parts = [
        frames[t].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("table"), "rows")
        for t in ROW_COUNT_TABLES
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _count_if(cond) -> F.Column:
    # SUM(CASE WHEN cond THEN 1 ELSE 0 END): NULL conditions count as 0.
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def task_core_stats(task_events: DataFrame) -> DataFrame:
    """17 statistics of task_events in one pass."""
    lo, hi = VALID_EVENT_TYPES
    et = F.col("event_type")
    per_task = task_events.groupBy("job_id", "task_index").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("timestamp").alias("min_ts"), F.max("timestamp").alias("max_ts"),
        F.min(et).alias("min_et"), F.max(et).alias("max_et"),
        _count_if(~et.between(lo, hi)).alias("bad_et"),
        F.min("priority").alias("min_p"), F.max("priority").alias("max_p"),
        F.min("cpu_request").alias("min_cpu"), F.max("cpu_request").alias("max_cpu"),
        F.min("ram_request").alias("min_ram"), F.max("ram_request").alias("max_ram"),
        F.min("disk_request").alias("min_disk"), F.max("disk_request").alias("max_disk"),
        _count_if(F.col("missing_info").isNotNull()).alias("mi"),
    )
    return per_task.agg(
        F.sum("n").cast("bigint").alias("total_rows"),
        F.count(F.lit(1)).alias("unique_tasks"),
        F.countDistinct("job_id").alias("unique_jobs"),
        F.min("min_ts").alias("min_timestamp"), F.max("max_ts").alias("max_timestamp"),
        F.min("min_et").alias("min_event_type"), F.max("max_et").alias("max_event_type"),
        F.sum("bad_et").cast("bigint").alias("invalid_event_type_rows"),
        F.min("min_p").alias("min_priority"), F.max("max_p").alias("max_priority"),
        F.min("min_cpu").alias("min_cpu_request"), F.max("max_cpu").alias("max_cpu_request"),
        F.min("min_ram").alias("min_ram_request"), F.max("max_ram").alias("max_ram_request"),
        F.min("min_disk").alias("min_disk_request"), F.max("max_disk").alias("max_disk_request"),
        F.sum("mi").cast("bigint").alias("missing_info_rows"),
    )


# Grouping ids of the three sets below (a bit per column that a set leaves out).
_BY_TASK, _BY_EVENT_TYPE, _BY_PRIORITY = 0b0011, 0b1101, 0b1110
_RANGED = ["timestamp", "event_type", "priority", "cpu_request", "ram_request", "disk_request"]


def task_event_totals(task_events: DataFrame) -> DataFrame:
    """A10, A12 and A13 from one scan: grouping sets by task, event type and priority.

    Task rows are folded to jobs and then to one row, so the result has a row
    for all tasks (``grouped`` = 'task'), one per event type and one per priority.
    """
    lo, hi = VALID_EVENT_TYPES
    keys = ["job_id", "task_index", "event_type", "priority"]
    ends = {f"{end}_{c}": (F.min if end == "min" else F.max, c) for c in _RANGED for end in ("min", "max")}
    first = task_events.groupingSets([keys[:2], keys[2:3], keys[3:]], *keys).agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("rows"),
        _count_if(~F.col("event_type").between(lo, hi)).alias("invalid"), F.count("missing_info").alias("flagged"),
        *[fn(c).alias(name) for name, (fn, c) in ends.items()])
    folded = {"rows": F.sum, "invalid": F.sum, "flagged": F.sum, **{name: fn for name, (fn, _) in ends.items()}}
    again = [fn(name).alias(name) for name, fn in folded.items()]
    jobs = first.groupBy("gid", "job_id", "event_type", "priority").agg(F.count(F.lit(1)).alias("tasks"), *again)
    total = jobs.groupBy("gid", "event_type", "priority").agg(F.sum("tasks").alias("tasks"), F.count("job_id").alias("jobs"), *again)
    name = F.when(F.col("gid") == _BY_TASK, "task").when(F.col("gid") == _BY_EVENT_TYPE, "event_type").when(F.col("gid") == _BY_PRIORITY, "priority")
    return total.select(name.alias("grouped"), "event_type", "priority", "tasks", "jobs",
                        *[F.col(n).cast("bigint").alias(n) if n in ("rows", "invalid", "flagged") else F.col(n) for n in folded])


def totals_core_stats(totals: DataFrame) -> DataFrame:
    """A10 from stored totals; one row of zeros and NULLs for an empty table."""
    task = totals.where(F.col("grouped") == "task")
    return task.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"), F.coalesce(F.sum("tasks"), F.lit(0)).alias("unique_tasks"),
                    F.coalesce(F.sum("jobs"), F.lit(0)).alias("unique_jobs"),
                    *[F.max(f"{end}_{c}").alias(f"{end}_{c}") for c in ("timestamp", "event_type") for end in ("min", "max")],
                    F.sum("invalid").alias("invalid_event_type_rows"),
                    *[F.max(f"{end}_{c}").alias(f"{end}_{c}") for c in _RANGED[2:] for end in ("min", "max")],
                    F.sum("flagged").alias("missing_info_rows"))


def totals_distribution(totals: DataFrame, column: str) -> DataFrame:
    """A12, A13 from stored totals."""
    return totals.where(F.col("grouped") == column).select(column, "rows").orderBy(F.col(column).asc_nulls_last())


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, ordered by value (NULL last)."""
    return (
        df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
        .orderBy(F.col(column).asc_nulls_last())
    )


def task_event_distribution(task_events: DataFrame) -> DataFrame:
    return value_distribution(task_events, "event_type")


def machine_event_distribution(machine_events: DataFrame) -> DataFrame:
    return value_distribution(machine_events, "event_type")


# Fixed value: priorities in the report.
PRIORITY_ROWS = 50


def priority_histogram(task_events: DataFrame, limit: int = PRIORITY_ROWS) -> DataFrame:
    """The ``limit`` lowest priority values and their row counts.

    Top-k by key: each task keeps at most ``limit`` rows, so the final merge
    is bounded whatever the number of distinct priorities.
    """
    return value_distribution(task_events, "priority").limit(limit)


def machine_capacity_ranges(machine_events: DataFrame) -> DataFrame:
    """A15."""
    return machine_events.agg(
        F.min("capacity_cpu").alias("min_cpu_capacity"),
        F.max("capacity_cpu").alias("max_cpu_capacity"),
        F.min("capacity_memory").alias("min_memory_capacity"),
        F.max("capacity_memory").alias("max_memory_capacity"),
    )


def usage_ranges(task_usage: DataFrame) -> DataFrame:
    """A16/P6."""
    return task_usage.agg(
        F.min("start_time").alias("min_start_time"),
        F.max("end_time").alias("max_end_time"),
        F.min("mean_cpu_usage_rate").alias("min_mean_cpu"),
        F.max("mean_cpu_usage_rate").alias("max_mean_cpu"),
        F.min("canonical_memory_usage").alias("min_canonical_mem"),
        F.max("canonical_memory_usage").alias("max_canonical_mem"),
        _count_if(~F.col("aggregation_type").isin(*VALID_AGGREGATION_TYPES))
        .alias("invalid_agg_type_rows"),
    )


# ---- fixed values: report section titles -----------------------------------
SECTION_TITLES = {
    "row_counts": "Row counts",
    "task_core_stats": "Task event stats",
    "task_event_distribution": "Task event type distribution",
    "priority_histogram": "Priority histogram (first 50 values)",
    "machine_event_distribution": "Machine event distribution",
    "machine_capacity_ranges": "Machine capacity ranges",
    "usage_ranges": "Task usage ranges",
}


def row_counts_of(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """A9 from the footers of staged tables."""
    out = None
    for t in ROW_COUNT_TABLES:
        one = footer_row(spark, paths[t], F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("table"), "rows")
        out = one if out is None else out.unionAll(one)
    return out


def machine_capacity_ranges_of(spark: SparkSession, path: str) -> DataFrame:
    """A15 from the footers of the staged table."""
    return footer_row(spark, path, F.min("capacity_cpu").alias("min_cpu_capacity"), F.max("capacity_cpu").alias("max_cpu_capacity"),
                      F.min("capacity_memory").alias("min_memory_capacity"), F.max("capacity_memory").alias("max_memory_capacity"))


def usage_ranges_of(spark: SparkSession, path: str) -> DataFrame:
    """Ranges from the footers of the staged table, invalid codes by a scan of their column."""
    ranges = footer_row(
        spark, path, F.min("start_time").alias("min_start_time"), F.max("end_time").alias("max_end_time"),
        F.min("mean_cpu_usage_rate").alias("min_mean_cpu"), F.max("mean_cpu_usage_rate").alias("max_mean_cpu"),
        F.min("canonical_memory_usage").alias("min_canonical_mem"), F.max("canonical_memory_usage").alias("max_canonical_mem"))
    invalid = spark.read.parquet(path).agg(
        _count_if(~F.col("aggregation_type").isin(*VALID_AGGREGATION_TYPES)).alias("n")).scalar()
    return ranges.withColumn("invalid_agg_type_rows", invalid)


def validation_sections(frames: dict[str, DataFrame], staged: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The report's sections; task events are scanned once. With ``staged`` paths
    row counts and ranges come from file footers."""
    spark, me = frames["task_events"].sparkSession, frames["machine_events"]
    path = scratch_path(spark, f"totals-{uuid.uuid4().hex}")
    task_event_totals(frames["task_events"]).coalesce(1).write.parquet(path)        # one row per event type and priority
    totals = spark.read.parquet(path)
    return {
        "row_counts": row_counts_of(spark, staged) if staged else row_counts(frames),
        "task_core_stats": totals_core_stats(totals),
        "task_event_distribution": totals_distribution(totals, "event_type"),
        "priority_histogram": totals_distribution(totals, "priority").limit(PRIORITY_ROWS),
        "machine_event_distribution": machine_event_distribution(me),
        "machine_capacity_ranges": machine_capacity_ranges_of(spark, staged["machine_events"]) if staged else machine_capacity_ranges(me),
        "usage_ranges": usage_ranges_of(spark, staged["task_usage"]) if staged else usage_ranges(frames["task_usage"]),
    }


def run_validation(frames: dict[str, DataFrame], path: str, staged: dict[str, str] | None = None) -> str:
    """K2: write the titled text report; every section is a few-row result."""
    from queuelens.sources.reports import titled_block, write_text

    blocks = [titled_block(SECTION_TITLES[k], df) for k, df in validation_sections(frames, staged).items()]
    return write_text(path, "\n\n".join(blocks) + "\n")
