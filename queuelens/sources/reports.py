"""Small result sinks (K2, K3): text reports and JSON metrics.

Only few-row results reach these writers (aggregates, top-k). They are
collected on the driver and written as one file through Hadoop's file system
API, so a path may be local or any URI that Spark can write. A result with
more than MAX_ROWS rows raises instead of being cut.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

MAX_ROWS = 100_000


def few_rows(df: DataFrame, max_rows: int = MAX_ROWS) -> list:
    """All rows of a small result; raises when there are more than ``max_rows``."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"a report holds at most {max_rows} rows; write larger results as a table")
    return rows


def format_rows(df: DataFrame, max_rows: int = MAX_ROWS) -> str:
    """Tab-separated header and rows of a small DataFrame."""
    lines = ["\t".join(df.columns)]
    for r in few_rows(df, max_rows):
        lines.append("\t".join("" if v is None else _fmt(v) for v in r))
    return "\n".join(lines)


def _fmt(v) -> str:
    return f"{v:.4f}" if isinstance(v, float) else str(v)


def titled_block(title: str, df: DataFrame) -> str:
    return f"{title}\n{'-' * len(title)}\n{format_rows(df)}"


def write_text(path: str, text: str) -> str:
    spark = SparkSession.active()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(target, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    return path


def write_json(path: str, payload: dict) -> str:
    return write_text(path, json.dumps(payload, indent=2, default=_json_default) + "\n")


def _json_default(v):
    if hasattr(v, "item"):
        return v.item()
    return str(v)


def rows_as_dicts(df: DataFrame, max_rows: int = MAX_ROWS) -> list[dict]:
    return [r.asDict(recursive=True) for r in few_rows(df, max_rows)]
