"""Pre-training profile of the feature table.

All statistics run over every row of the table; the bounded sample (O3) is
a separate operator for callers that want plot points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.functions.labels import DEFAULT_CLIP, clip
from queuelens.operators.quantiles import quantiles_wide
from queuelens.operators.stats import correlation_matrix, histogram, unpivot
from queuelens.sources.schemas import LABEL, MODEL_FEATURES

# Label quantile levels, histogram bin counts, features plotted.
LABEL_LEVELS = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9,
                "p95": 0.95, "p99": 0.99}
LABEL_BINS = 200
FEATURE_BINS = 100
HISTOGRAM_FEATURES = MODEL_FEATURES[:8]


def split_counts(features: DataFrame) -> DataFrame:
    """Rows per split and the total."""
    total = features.agg(F.count(F.lit(1))).scalar()
    return features.groupBy("split").agg(F.count(F.lit(1)).alias("rows")).select(
        "split", "rows", total.alias("rows_total"))


def clipped_label(features: DataFrame, clip_target: float | None = DEFAULT_CLIP) -> DataFrame:
    return features.select("split", clip(F.col(LABEL), clip_target).alias("label"))


def label_quantiles(features: DataFrame, clip_target: float | None = DEFAULT_CLIP,
                    digits: int | None = None) -> DataFrame:
    """Label quantiles over all rows."""
    return quantiles_wide(clipped_label(features, clip_target), "label", LABEL_LEVELS, digits=digits)


def label_quantiles_by_split(features: DataFrame, clip_target: float | None = DEFAULT_CLIP,
                             digits: int | None = None) -> DataFrame:
    """The same per split; a split without rows has no row."""
    return quantiles_wide(clipped_label(features, clip_target), "label", LABEL_LEVELS,
                          by=["split"], digits=digits)


def label_histogram(features: DataFrame, clip_target: float | None = DEFAULT_CLIP) -> DataFrame:
    """200 equal-width bins of the clipped label."""
    return histogram(clipped_label(features, clip_target), "label", LABEL_BINS)


def feature_histograms(features: DataFrame) -> DataFrame:
    """100 bins for each of the first eight model features, long form."""
    return histogram(unpivot(features, HISTOGRAM_FEATURES), "value", FEATURE_BINS, by=["feature"])


def feature_correlation(features: DataFrame) -> DataFrame:
    """Pearson correlation matrix of the model features, long form."""
    return correlation_matrix(features, MODEL_FEATURES)
