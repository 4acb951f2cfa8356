"""Feature-table Parquet scans (S9-S11) and sink (K1)."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from queuelens.sources import files


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """S9 + S11: the feature table; a missing path raises FileNotFoundError."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            raise FileNotFoundError(f"Features parquet not found at {path}. Build it first.") from exc
        raise


def split_view(spark: SparkSession, path: str, split: str | None, columns: list[str]) -> DataFrame:
    """One split, selected columns. The split filter prunes partitions
    (the table is written partitioned by split) and the column list reaches
    the scan's read schema."""
    df = read_features(spark, path)
    if split is not None:
        df = df.where(F.col("split") == split)
    return df.select(*columns)


# Fixed value: rows of a row group of the feature table.
ROW_GROUP_ROWS = 2_000_000


def write_features(features: DataFrame, path: str, partition_by_split: bool = True, row_group_rows: int = ROW_GROUP_ROWS) -> str:
    """K1: ZSTD Parquet in row groups of ``row_group_rows`` rows; partitioned by
    split so later split reads prune files. The group's byte size is set out of
    the way, so the row count alone closes a group; the writer buffers a whole one."""
    writer = (features.write.mode("overwrite").option("compression", "zstd")
              .option("parquet.block.row.count.limit", str(row_group_rows)).option("parquet.block.size", str(1 << 30)))
    if partition_by_split:
        writer = writer.partitionBy("split")
    writer.parquet(path)
    return path


def head_sample(spark: SparkSession, path: str, columns: list[str], cap: int) -> DataFrame:
    """O3: the first ``cap`` rows in file order (files by name, rows by position).

    Row counts per file come from a scan of no column and add up in name order;
    only files that begin before the cap are read again, and each row's place is
    its file's offset plus its position in the file. Nothing is sorted.
    """
    found = read_features(spark, path)
    name = F.col("_metadata.file_path")
    counts = found.groupBy(name.alias("file")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("file")) - F.col("n")          # one row per file
    begins = counts.select("file", before.alias("begin")).where(F.col("begin") < cap)
    wanted = begins.collect()                                              # at most cap files, each with a row
    if not wanted:
        return found.select(*columns).limit(0)
    reader = spark.read.option("basePath", path) if files.is_folder(spark, path) else spark.read
    first = reader.parquet(*[unquote(r["file"]) for r in wanted])
    offsets = F.broadcast(spark.createDataFrame(wanted, begins.schema))
    placed = first.select(*columns, name.alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return (placed.join(offsets, F.col("__file") == F.col("file")).where(F.col("begin") + F.col("__row") < cap).select(*columns))
