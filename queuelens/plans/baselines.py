"""Constant baselines on the unclipped label.

The train mean and median are one-row results; they enter the per-split
aggregation as scalar subqueries, so no row of the feature table is joined
or replicated for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.operators.quantiles import quantiles_wide
from queuelens.sources.schemas import LABEL

# Train distribution levels.
TRAIN_LEVELS = {"train_median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def _train(features: DataFrame) -> DataFrame:
    return features.where(F.col("split") == "train")


def train_distribution(features: DataFrame, label: Column | None = None) -> DataFrame:
    """Rows, mean, median, p90/95/99/99.9 and max of the train label."""
    y = label if label is not None else F.col(LABEL)
    train = _train(features).select(y.alias("__y"))
    q = quantiles_wide(train, "__y", TRAIN_LEVELS)
    qs = q.select(F.struct(*TRAIN_LEVELS).alias("q")).scalar()
    return train.agg(
        F.count(F.lit(1)).alias("train_rows"),
        F.avg("__y").alias("train_mean"),
        F.max("__y").alias("max_delay"),
    ).select(
        "train_rows", "train_mean",
        *[qs.getField(k).alias(k) for k in TRAIN_LEVELS], "max_delay",
    )


def baseline_errors(df: DataFrame, y: Column, mean: Column, median: Column,
                    by: list[str] | None = None) -> DataFrame:
    """Mean, and MAE / RMSE of the two constant predictors (per group or overall)."""
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(y).alias("mean_delay"),
        F.avg(F.abs(y - mean)).alias("mae_mean_baseline"),
        F.sqrt(F.avg(F.pow(y - mean, 2))).alias("rmse_mean_baseline"),
        F.avg(F.abs(y - median)).alias("mae_median_baseline"),
        F.sqrt(F.avg(F.pow(y - median, 2))).alias("rmse_median_baseline"),
    )


def constant_baselines(features: DataFrame) -> DataFrame:
    """Per split rows, mean and median delay, and both baselines' errors."""
    y = F.col(LABEL)
    # Per-split medians (three small rows) also give the train median.
    medians = quantiles_wide(features, LABEL, {"median_delay": 0.5}, ["split"])
    median = medians.where(F.col("split") == "train").select("median_delay").scalar()
    mean = _train(features).agg(F.avg(y)).scalar()
    errs = baseline_errors(features, y, mean, median, ["split"])
    return (
        errs.join(medians, "split")
        .select("split", "rows", "mean_delay", "median_delay", "mae_mean_baseline",
                "rmse_mean_baseline", "mae_median_baseline", "rmse_median_baseline")
        .orderBy("split")
    )
