"""queuelens: queueing-delay analytics on cluster-trace event tables, on Spark.

Layout:
  sources/    scans, schemas, test adapters, sinks
  functions/  column expressions (time buckets, split, label transforms, bins)
  operators/  reusable DataFrame operators (first-by, prefix sum, histograms, ...)
  plans/      the stage plans: features, validation, baselines, EDA, evaluation
  model/      boosted-tree regressor on Spark MLlib
  streaming/  incremental form of the per-minute event counts
"""

from queuelens.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
