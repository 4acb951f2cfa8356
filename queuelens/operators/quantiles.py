"""Exact quantiles (linear interpolation) with bounded work per task.

Spark's exact ``percentile`` keeps a value->count map per group and merges all
of a group's maps in one task; a sketch's partial results meet in one task
too. Here each needed rank is closed in by plain counts:

1. one pass counts each group and takes its smallest and largest value;
2. the open value range of a group is cut into BINS equal parts; rows are
   counted per (group, range, part), partially in each task first, and the parts
   that hold a needed rank become the next, narrower ranges (their own smallest
   and largest values);
3. a range is done when it is a single value, or holds at most BINS rows: then
   its distinct values are counted and the rank is read off.

No task sees more than BINS rows per group, range and map task. What reaches
the driver is one row per group and needed rank; more than MAX_GROUPS groups
raise an error. The interpolation is ``lo + (hi - lo) * frac`` (NumPy "linear",
SQL ``quantile_cont``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 65_536
#: Groups are splits, subsets or series: few. Their brackets pass through the driver.
MAX_GROUPS = 10_000


class _Range:
    """An open value range of one group: its rows and the ranks it holds."""

    def __init__(self, group: int, low: float, high: float, below: int, rows: int, ranks: set[int]):
        self.group, self.low, self.high, self.below, self.rows, self.ranks = group, low, high, below, rows, ranks


def _keyed(df: DataFrame, value: str | Column, by: list[str]) -> DataFrame:
    v = F.col(value) if isinstance(value, str) else value
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    return df.select(key.alias("g"), v.cast("double").alias("v")).where(F.col("v").isNotNull())


def _in_ranges(data: DataFrame, groups: list, ranges: list[_Range]) -> DataFrame:
    """Rows inside the ranges, tagged with the range's number. The table of
    ranges has at most one row per group and needed rank."""
    key_type = data.schema["g"].dataType
    schema = T.StructType([T.StructField("rg", key_type), T.StructField("r", T.IntegerType()),
                           T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())])
    table = data.sparkSession.createDataFrame(
        [(groups[x.group], i, x.low, x.high) for i, x in enumerate(ranges)], schema)
    inside = data["g"].eqNullSafe(table["rg"]) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
    return data.join(F.broadcast(table), inside).select("r", "v", "lo", "hi")


def _located(counted: DataFrame, order: str, ranges: list[_Range]) -> list:
    """Of counted parts (r, <order>, c, lo, hi), those that hold a needed rank."""
    running = Window.partitionBy("r").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ends = counted.withColumn("end", F.sum("c").over(running))
    wanted = counted.sparkSession.createDataFrame(
        [(i, k - x.below) for i, x in enumerate(ranges) for k in sorted(x.ranks)], "wr int, k long")
    hit = (F.col("r") == F.col("wr")) & (F.col("k") >= F.col("end") - F.col("c")) & (F.col("k") < F.col("end"))
    return ends.join(F.broadcast(wanted), hit).select("r", "k", "lo", "hi", "c", "end").collect()


def values_at_ranks(df: DataFrame, value: str | Column, ranks, by: list[str] | None = None) -> dict:
    """``{group: (rows, {rank: value})}`` for 0-based ``ranks(rows)`` of each
    group (a tuple of the ``by`` values), NULL values left out."""
    by = list(by or [])
    data = _keyed(df, value, by)
    stats = data.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).limit(
        MAX_GROUPS + 1).collect()
    if len(stats) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    groups = [s["g"] for s in stats]
    found: list[dict[int, float]] = [{} for _ in stats]
    open_ranges = [_Range(i, s["lo"], s["hi"], 0, s["n"], set(ranks(s["n"]))) for i, s in enumerate(stats)]
    while open_ranges:
        for x in open_ranges:
            if x.low == x.high:
                found[x.group].update(dict.fromkeys(x.ranks, x.low))
        open_ranges = [x for x in open_ranges if x.low < x.high]
        small = [x for x in open_ranges if x.rows <= BINS]
        if small:
            counted = _in_ranges(data, groups, small).groupBy("r", "v").agg(F.count("*").alias("c")).select(
                "r", F.col("v").alias("lo"), F.col("v").alias("hi"), "c")
            for h in _located(counted, "lo", small):
                x = small[h["r"]]
                found[x.group][h["k"] + x.below] = h["lo"]
        large = [x for x in open_ranges if x.rows > BINS]
        if not large:
            break
        # Halves first, so that the width of a very wide range stays finite.
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        part = F.least(F.floor(share * BINS).cast("int"), F.lit(BINS - 1))
        counted = _in_ranges(data, groups, large).groupBy("r", part.alias("part")).agg(
            F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        narrower: dict[tuple, _Range] = {}
        for h in _located(counted, "part", large):
            x = large[h["r"]]
            below = x.below + h["end"] - h["c"]
            narrower.setdefault((x.group, below), _Range(x.group, h["lo"], h["hi"], below, h["c"], set())
                                ).ranks.add(h["k"] + x.below)
        open_ranges = list(narrower.values())
    return {tuple(groups[i]) if by else (): (s["n"], found[i]) for i, s in enumerate(stats)}


def _interpolated(df: DataFrame, value: str | Column, probs: list[float], by: list[str]) -> dict[tuple, list[float]]:
    def ranks(n: int) -> list[int]:
        return [r for p in probs for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))]

    out = {}
    for group, (n, at) in values_at_ranks(df, value, ranks, by).items():
        pos = [p * (n - 1) for p in probs]
        out[group] = [at[math.floor(x)] + (at[math.ceil(x)] - at[math.floor(x)]) * (x - math.floor(x)) for x in pos]
    return out


def exact_quantiles(df: DataFrame, value: str | Column, probs: list[float],
                    by: list[str] | None = None) -> DataFrame:
    """Long form: ``by..., qi (index into probs), quantile``; groups without a value have no row."""
    by = list(by or [])
    rows = [(*g, i, q) for g, qs in _interpolated(df, value, probs, by).items() for i, q in enumerate(qs)]
    schema = T.StructType([*df.select(*by).schema.fields, T.StructField("qi", T.IntegerType()),
                           T.StructField("quantile", T.DoubleType())])
    return df.sparkSession.createDataFrame(rows, schema)


def quantiles_wide(df: DataFrame, value: str | Column, named: dict[str, float],
                   by: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """One column per named quantile (``{'p50': 0.5, ...}``), one row per group
    (without ``by`` always one row, NULL on an empty input)."""
    by = list(by or [])
    found = _interpolated(df, value, list(named.values()), by)
    rows = [(*g, *qs) for g, qs in found.items()]
    if not by and not rows:
        rows = [(None,) * len(named)]
    schema = T.StructType([*df.select(*by).schema.fields, *[T.StructField(k, T.DoubleType()) for k in named]])
    out = df.sparkSession.createDataFrame(rows, schema)
    if digits is None:
        return out
    return out.select(*by, *[F.round(k, digits).alias(k) for k in named])
