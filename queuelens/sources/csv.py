"""Raw trace scans: headerless CSV under a fixed schema.

The empty string is NULL, fields are comma separated, there is no header and
no type inference. Parse errors are not ignored: ``FAILFAST`` raises on a
value that does not fit its column or a row with the wrong field count. The
parser reads every field of a row (``columnPruning`` is off for the scan), and
a filter that always holds uses every column, so all values are converted and
malformed rows fail even when only a few columns are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.sources.schemas import RAW_TABLES, boolean_columns, scan_schema
from queuelens.sources.staged import stage_all


def read_trace_csv(spark: SparkSession, path: str, columns: list) -> DataFrame:
    """Scan a headerless CSV file or folder with an explicit schema."""
    df = (
        spark.read.schema(scan_schema(columns))
        .option("header", "false")
        .option("sep", ",")
        .option("nullValue", "")
        .option("emptyValue", "")
        .option("mode", "FAILFAST")
        .option("enforceSchema", "true")
        .option("columnPruning", "false")
        .csv(path)
    )
    df = df.where(F.xxhash64(*df.columns) >= F.lit(-2**63))
    bools = set(boolean_columns(columns))
    if not bools:
        return df
    return df.select(
        *[F.col(c).cast("boolean").alias(c) if c in bools else F.col(c) for c in df.columns]
    )


def _table_reader(name: str):
    columns = RAW_TABLES[name]

    def read(spark: SparkSession, data_dir: str) -> DataFrame:
        return read_trace_csv(spark, f"{data_dir}/{name}.csv", columns)

    read.__name__ = f"read_{name}"
    read.__doc__ = f"Scan {name}.csv under its fixed schema."
    return read


# S2-S7
read_task_events = _table_reader("task_events")
read_job_events = _table_reader("job_events")
read_machine_events = _table_reader("machine_events")
read_machine_attributes = _table_reader("machine_attributes")
read_task_constraints = _table_reader("task_constraints")
read_task_usage = _table_reader("task_usage")

READERS = {
    "task_events": read_task_events,
    "job_events": read_job_events,
    "machine_events": read_machine_events,
    "machine_attributes": read_machine_attributes,
    "task_constraints": read_task_constraints,
    "task_usage": read_task_usage,
}


def register_views(spark: SparkSession, data_dir: str) -> dict[str, DataFrame]:
    """Expose the six raw tables as temp views; returns the frames."""
    frames = {}
    for name, reader in READERS.items():
        df = reader(spark, data_dir)
        df.createOrReplaceTempView(name)
        frames[name] = df
    return frames


def stage_as_parquet(spark: SparkSession, data_dir: str, out_dir: str) -> dict[str, str]:
    """Parse each raw CSV table once, strictly, and write it as staged Parquet.

    CSV cannot skip columns on disk, so every scan of a CSV table parses all
    of it. Staging turns the later scans into pruned, filter-pushed columnar
    reads laid out by key (``sources/staged.py``). Parsing is strict here, so a
    malformed row fails the staging.
    """
    return stage_all(spark, {name: lambda read=read: read(spark, data_dir) for name, read in READERS.items()}, out_dir)


def write_trace_csv(df: DataFrame, path: str) -> str:
    """Write a raw table in the layout that the scans read (booleans as 0/1), in gzip files."""
    flags = [F.col(n).cast("int").alias(n) if t == "boolean" else F.col(n) for n, t in df.dtypes]
    df.select(*flags).write.option("header", "false").option("emptyValue", "").option("compression", "gzip").csv(path)
    return path
