"""Invariants of the feature table on the adapter views."""

from pyspark.sql import functions as F

from conftest import SF_MID
from queuelens.plans import eda as EP
from queuelens.plans import features as FP
from queuelens.sources.adapters import adapter_frames


def test_feature_invariants(spark):
    fr = adapter_frames(spark, SF_MID, ["task_events", "machine_events"])
    te = fr["task_events"]
    f = FP.build_features(te, fr["machine_events"]).cache()
    assert f.count() == 45832                       # feature rows at sf0.01
    assert f.where(F.col("queue_delay_seconds") < 0).count() == 0
    # a job never lands in two splits
    assert f.groupBy("job_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    # last backlog value equals all submits minus all schedules
    b = FP.backlog(te).orderBy(F.desc("minute_bucket")).first()
    tot = te.agg(F.count(F.when(F.col("event_type") == 0, 1)).alias("s"),
                 F.count(F.when(F.col("event_type") == 1, 1)).alias("c")).first()
    assert b.pending_estimate == tot.s - tot.c
    # histogram counts add up to rows
    h = EP.label_histogram(f).agg(F.sum("rows")).first()[0]
    assert h == f.count()
    fh = EP.feature_histograms(f).groupBy("feature").agg(F.sum("rows").alias("n")).collect()
    assert all(r.n <= f.count() for r in fh) and len(fh) == 8
    f.unpersist()
