"""Global running sum without a single-partition window.

``SUM(v) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)`` with no PARTITION BY
makes Spark move every row into one task. Here rows are cut into blocks of
``block`` consecutive keys: a window per block computes the running sum inside
it (blocks are bounded in size and spread over tasks), and each block adds the
total of all earlier blocks. The per-block totals table has one row per block
and is the only part ordered globally.

The key must be unique per row (e.g. the output of a GROUP BY on it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, key: str, value: str, out: str, block: int) -> DataFrame:
    blk = "__blk"
    keyed = df.withColumn(blk, F.floor(F.col(key) / F.lit(block)).cast("bigint"))
    inner = Window.partitionBy(blk).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    within = keyed.withColumn("__in", F.sum(value).over(inner))

    totals = keyed.groupBy(blk).agg(F.sum(value).alias("__tot"))
    # NULL keys sort last, as in SQL's default ascending order.
    before = Window.orderBy(F.col(blk).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(blk).alias("__ob"),
                            F.coalesce(F.sum("__tot").over(before), F.lit(0)).alias("__off"))

    # Null-safe equality: no IsNotNull filter is inferred into one branch only,
    # so both branches keep the same per-key subplan and its shuffle is reused.
    return (
        within.join(offsets, within[blk].eqNullSafe(offsets["__ob"]), "inner")
        .withColumn(out, (F.col("__in") + F.col("__off")).cast("bigint"))
        .drop(blk, "__ob", "__in", "__off")
    )
