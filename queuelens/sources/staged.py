"""Staged raw tables: parsed once, laid out by key, with statistics in their footers.

Task events are bucketed by job and sorted by (job, task) inside the buckets, so
that per-task and per-job aggregates and the joins between them need no shuffle.
The files lie in a plain folder; a small layout file beside them lets any later
session read them as buckets again. Where one bucket is far larger than the others
(one job with a large share of all events) the table is read as plain Parquet, so
that aggregates combine in the tasks of many files instead of one task per bucket.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from queuelens.sources import files

#: Tables with a key: bucket column and order inside a bucket.
KEYED = {"task_events": ("job_id", ["job_id", "task_index"])}
#: A bucket that holds more than this many times the mean, and at least MIN_SKEWED bytes, is skewed.
SKEW_FACTOR, MIN_SKEWED = 4, 256 << 20
_BUCKET = re.compile(r"_(\d{5})\.c\d{3}")


def _table_name(path: str) -> str:
    return "staged_" + hashlib.sha256(path.encode()).hexdigest()[:16]


def stage(df: DataFrame, path: str, key: tuple[str, list[str]] | None = None, buckets: int | None = None, dealt: int | None = None) -> str:
    """Write a table as ZSTD Parquet, in ``buckets`` buckets (the session's shuffle partitions) if it has a key.
    Rows that are in ``dealt`` partitions by the hash of the key already are written as that many buckets, without a shuffle."""
    spark = df.sparkSession
    if key is None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return path
    column, order = key
    buckets = dealt or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.sql(f"DROP TABLE IF EXISTS {_table_name(path)}")
    # The hint lets Spark split the partition of a job with many events over several tasks.
    rows = df if dealt else df.hint("rebalance", column)
    (rows.write.mode("overwrite").option("compression", "zstd").option("path", path)
     .bucketBy(buckets, column).sortBy(*order).saveAsTable(_table_name(path)))
    spark.sql(f"DROP TABLE {_table_name(path)}")            # the files stay
    files.write_file(spark, f"{path}.layout.json", json.dumps(
        {"schema": df.schema.json(), "column": column, "order": order, "buckets": buckets}))
    return path


def bucket_sizes(spark: SparkSession, path: str, buckets: int) -> list[int]:
    """Bytes of each bucket."""
    sizes = [0] * buckets
    for name, size in files.sizes(spark, path):
        found = _BUCKET.search(name)
        if found:
            sizes[int(found.group(1))] += size
    return sizes


def read_staged(spark: SparkSession, path: str) -> DataFrame:
    """A staged table, in its buckets if it has them and none is skewed."""
    folder, _, name = path.rpartition("/")
    if f"{name}.layout.json" not in files.names(spark, folder):
        return spark.read.parquet(path)
    layout = json.loads(files.read_file(spark, f"{path}.layout.json"))
    sizes = bucket_sizes(spark, path, layout["buckets"])
    if max(sizes) > max(MIN_SKEWED, SKEW_FACTOR * sum(sizes) / len(sizes)):
        return spark.read.parquet(path)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(json.loads(layout["schema"])))
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_table_name(path)} ({columns}) USING parquet CLUSTERED BY ({layout['column']}) "
              f"SORTED BY ({', '.join(layout['order'])}) INTO {layout['buckets']} BUCKETS LOCATION '{path}'")
    return spark.table(_table_name(path))


def stage_all(spark: SparkSession, readers: dict[str, Callable[[], DataFrame]], out_dir: str, buckets: int | None = None,
              dealt: dict[str, int] | None = None) -> dict[str, str]:
    """Stage tables by name; ``dealt``: partitions of those that lie by their key already."""
    return {name: stage(read(), f"{out_dir}/{name}.parquet", KEYED.get(name), buckets, (dealt or {}).get(name)) for name, read in readers.items()}


def read_columnar(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet folder through the source that answers COUNT, MIN and MAX from file footers."""
    known = spark.conf.get("spark.sql.sources.useV1SourceList")
    spark.conf.set("spark.sql.sources.useV1SourceList", ",".join(x for x in known.split(",") if x != "parquet"))
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.useV1SourceList", known)


def footer_row(spark: SparkSession, path: str, *aggregates: Column) -> DataFrame:
    """One row of COUNT, MIN and MAX aggregates, from the footers without reading rows.

    A row group without a range for a column (all NULL, or a NaN in it) has no answer
    in its footer; the aggregates are then scanned. Runs its job when called.
    """
    pushdown = "spark.sql.parquet.aggregatePushdown"
    before = spark.conf.get(pushdown)
    spark.conf.set(pushdown, "true")
    try:
        found = read_columnar(spark, path).agg(*aggregates)
        row = found.first()
    except Exception as e:          # Spark wraps it in one of several classes
        if "No min/max found" not in str(e):
            raise
        found = spark.read.parquet(path).agg(*aggregates)
        row = found.first()
    finally:
        spark.conf.set(pushdown, before)
    # Footers keep the least zero as -0.0.
    return spark.createDataFrame([tuple(v + 0.0 if isinstance(v, float) else v for v in row)], found.schema)
