"""Trace-shaped views over the driver's test tables.

The test data has no cluster trace, so these views give its order/lineitem
tables the six raw tables' shape: a job is an order, a task is (order, line
number), a machine is a supplier. One SQL text serves both engines; only the
microsecond conversion of a timestamp and the table references differ.

Spark side: each view is a DataFrame built by ``spark.sql`` with the base
parquet frames passed as parameters, so no global view state is involved. Task
events take a form of their own there: lines and orders meet once, in as many
parts as their bytes ask for, and each line then gives its three events, so that
the work of a task and what is shuffled per event do not grow with the tables.
DuckDB side (oracle): the same text as CTEs over the pre-registered views.
"""

from __future__ import annotations

import math
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.sources import files

BASE_TABLES = ("lineitem", "orders", "supplier", "nation", "part")

# ---- fixed values: adapter view definitions (shared by Spark and DuckDB) ----
ADAPTER_SQL: dict[str, str] = {
    "task_events": """
select US(o_orderdate) + (l_partkey * 7919 % 86400) * 1000000 as timestamp,
       case when l_linestatus = 'F' and l_linenumber = 3 then cast(2 as bigint) end as missing_info,
       l_orderkey as job_id, cast(l_linenumber as bigint) as task_index,
       cast(null as bigint) as machine_id, 0 as event_type,
       concat('user', cast(o_custkey as varchar(20))) as user_name,
       cast(o_custkey % 4 as int) as scheduling_class,
       case when l_linenumber = 7 then null
            else cast(substr(o_orderpriority, 1, 1) as int) + 5 * cast(l_partkey % 13 as int) end as priority,
       case when l_linenumber = 6 then null else l_quantity / 50.0 end as cpu_request,
       l_discount as ram_request,
       case when l_linenumber = 5 then null else l_tax end as disk_request,
       l_returnflag = 'R' as different_machine_constraint
from {lineitem} join {orders} on l_orderkey = o_orderkey
union all
select US(o_orderdate) + (l_partkey * 7919 % 86400) * 1000000 + DELAY, cast(null as bigint),
       l_orderkey, cast(l_linenumber as bigint),
       case when l_suppkey % 10 = 9 then l_suppkey + 1000000 else l_suppkey end, 1,
       cast(null as varchar(20)), cast(l_suppkey % 4 as int),
       case when l_linenumber = 7 then 7 end, l_quantity / 50.0, l_discount, l_tax,
       cast(null as boolean)
from {lineitem} join {orders} on l_orderkey = o_orderkey
union all
select US(o_orderdate) + (l_partkey * 7919 % 86400) * 1000000 + DELAY + cast(l_quantity as bigint) * 60000000,
       cast(null as bigint), l_orderkey, cast(l_linenumber as bigint), l_suppkey,
       case when l_linenumber = 7 then 9 when l_returnflag = 'N' then 4 when l_returnflag = 'A' then 5 else 2 end,
       cast(null as varchar(20)), cast(null as int), cast(null as int), l_quantity / 50.0, l_discount, l_tax,
       false
from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    "machine_events": """
select cast(0 as bigint) as timestamp, s_suppkey as machine_id, 0 as event_type, 'p0' as platform_id,
       (s_suppkey % 4 + 1) / 4.0e0 as capacity_cpu, abs(s_acctbal) / 10000.0e0 as capacity_memory
from {supplier}
union all
select cast(1000000000000000 as bigint), s_suppkey, 2, 'p0',
       case when s_suppkey % 3 = 0 then null else 1.0e0 end, 0.5e0
from {supplier}""",
    "job_events": """
select US(o_orderdate) as timestamp, cast(null as bigint) as missing_info, o_orderkey as job_id,
       0 as event_type, concat('user', cast(o_custkey as varchar(20))) as user_name,
       cast(o_custkey % 4 as int) as scheduling_class, o_orderstatus as job_name,
       o_orderpriority as logical_job_name
from {orders}""",
    "machine_attributes": """
select cast(0 as bigint) as timestamp, s_suppkey as machine_id, 'nation' as attribute_name,
       n_name as attribute_value, s_suppkey % 2 = 1 as attribute_deleted
from {supplier} join {nation} on s_nationkey = n_nationkey""",
    "task_constraints": """
select US(l_shipdate) as timestamp, l_orderkey as job_id, cast(l_linenumber as bigint) as task_index,
       'brand' as attribute_name, p_brand as attribute_value, cast(p_size % 4 as int) as comparison_operator
from {lineitem} join {part} on l_partkey = p_partkey""",
    "task_usage": """
select US(l_shipdate) as start_time, US(l_shipdate) + 300000000 as end_time, l_orderkey as job_id,
       cast(l_linenumber as bigint) as task_index, l_suppkey as machine_id,
       l_discount as mean_cpu_usage_rate, l_tax as canonical_memory_usage, l_tax as assigned_memory_usage,
       0.0e0 as unmapped_page_cache_memory_usage, 0.0e0 as total_page_cache_memory_usage,
       l_tax as maximum_memory_usage, 0.0e0 as mean_disk_io_time, l_quantity / 50.0 as mean_local_disk_space_used,
       l_discount as maximum_cpu_usage, 0.0e0 as maximum_disk_io_time, cast(null as double) as cycles_per_instruction,
       cast(null as double) as memory_accesses_per_instruction, 1.0e0 as sample_portion,
       cast(l_linenumber % 3 as int) as aggregation_type, l_discount as sampled_cpu_usage
from {lineitem}""",
}

_US = re.compile(r"US\((\w+)\)")

# Queueing delay of a task in microseconds: whole seconds from 1 s to about two
# days, skewed, with ties, on both sides of the label clip. Some schedules name
# machines that do not exist (the joins' misses).
DELAY = "(1 + (l_suppkey % 97) * (l_suppkey % 97) * (1 + l_partkey % 7) * (1 + l_linenumber % 3)) * 1000000"


# The same task events from one join: per column its value in a line's submit, schedule and end.
_SUBMITTED = "US(o_orderdate) + (l_partkey * 7919 % 86400) * 1000000"
_EVENT_COLUMNS: dict[str, tuple[str, str, str]] = {
    "timestamp": (_SUBMITTED, f"{_SUBMITTED} + DELAY", f"{_SUBMITTED} + DELAY + cast(l_quantity as bigint) * 60000000"),
    "missing_info": ("case when l_linestatus = 'F' and l_linenumber = 3 then cast(2 as bigint) end", "cast(null as bigint)", "cast(null as bigint)"),
    "job_id": ("l_orderkey",) * 3,
    "task_index": ("cast(l_linenumber as bigint)",) * 3,
    "machine_id": ("cast(null as bigint)", "case when l_suppkey % 10 = 9 then l_suppkey + 1000000 else l_suppkey end", "l_suppkey"),
    "event_type": ("0", "1", "case when l_linenumber = 7 then 9 when l_returnflag = 'N' then 4 when l_returnflag = 'A' then 5 else 2 end"),
    "user_name": ("concat('user', cast(o_custkey as varchar(20)))", "cast(null as varchar(20))", "cast(null as varchar(20))"),
    "scheduling_class": ("cast(o_custkey % 4 as int)", "cast(l_suppkey % 4 as int)", "cast(null as int)"),
    "priority": ("case when l_linenumber = 7 then null else cast(substr(o_orderpriority, 1, 1) as int) + 5 * cast(l_partkey % 13 as int) end",
                 "case when l_linenumber = 7 then 7 end", "cast(null as int)"),
    "cpu_request": ("case when l_linenumber = 6 then null else l_quantity / 50.0 end", "l_quantity / 50.0", "l_quantity / 50.0"),
    "ram_request": ("l_discount",) * 3,
    "disk_request": ("case when l_linenumber = 5 then null else l_tax end", "l_tax", "l_tax"),
    "different_machine_constraint": ("l_returnflag = 'R'", "cast(null as boolean)", "false"),
}
_TASK_EVENTS = "select " + ",\n       ".join(
    f"{a} as {name}" if a == b == c else f"case e when 0 then {a} when 1 then {b} else {c} end as {name}"
    for name, (a, b, c) in _EVENT_COLUMNS.items()) + """
from (select /*+ MERGE(o) */ * from {lineitem} l join {orders} o on l_orderkey = o_orderkey) lateral view explode(array(0, 1, 2)) as e"""

#: Parquet bytes of lines and orders in one part of the task events.
PART_BYTES = 8 << 20


def event_parts(spark: SparkSession, sf_dir: str) -> tuple[int, bool]:
    """Partitions that the task events lie in, by job, and whether to name them: Spark
    merges small ones by their compressed bytes, which says little about sorted keys."""
    size = sum(files.size(spark, os.path.join(sf_dir, f"{t}.parquet")) for t in ("lineitem", "orders"))
    wanted, least = math.ceil(size / PART_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(wanted, least), wanted > spark.sparkContext.defaultParallelism


def _task_events(spark: SparkSession, sf_dir: str, lines: DataFrame, orders: DataFrame) -> DataFrame:
    n, named = event_parts(spark, sf_dir)
    if named:
        lines, orders = lines.repartition(n, F.col("l_orderkey")), orders.repartition(n, F.col("o_orderkey"))
    return spark.sql(_render(_TASK_EVENTS, "spark"), lineitem=lines, orders=orders)


def _render(text: str, engine: str) -> str:
    text = text.replace("DELAY", DELAY)
    if engine == "spark":
        return _US.sub(r"unix_micros(cast(\1 as timestamp))", text)
    if engine == "duckdb":
        return _US.sub(r"epoch_us(\1)", text).format(**{t: t for t in BASE_TABLES})
    raise ValueError(engine)


def base_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(os.path.join(sf_dir, f"{t}.parquet")) for t in BASE_TABLES}


def adapter_frames(spark: SparkSession, sf_dir: str, names=None) -> dict[str, DataFrame]:
    """The six raw tables as DataFrames derived from the test tables."""
    base = base_frames(spark, sf_dir)
    out = {}
    for name in names or ADAPTER_SQL:
        if name == "task_events":
            out[name] = _task_events(spark, sf_dir, base["lineitem"], base["orders"])
            continue
        text = _render(ADAPTER_SQL[name], "spark")
        used = {t: base[t] for t in BASE_TABLES if "{" + t + "}" in text}
        out[name] = spark.sql(text, **used)
    return out


def duckdb_ctes(*names: str) -> str:
    """``WITH`` prefix defining the named adapter views for the DuckDB oracle."""
    parts = [f"{n} AS ({_render(ADAPTER_SQL[n], 'duckdb')}\n)" for n in names]
    return "WITH " + ",\n".join(parts)


def adapter_stream(spark: SparkSession, sf_dir: str, name: str, streamed: str = "lineitem") -> DataFrame:
    """The named view with ``streamed`` read as a file stream (others static)."""
    base = base_frames(spark, sf_dir)
    stream = (spark.readStream.schema(base[streamed].schema)
              .option("pathGlobFilter", f"{streamed}.parquet").parquet(sf_dir))
    text = _render(ADAPTER_SQL[name], "spark")
    used = {t: (stream if t == streamed else base[t]) for t in BASE_TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)
