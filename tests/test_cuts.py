"""No silent cuts: reports raise, masters without a shared folder raise, the fixture is telling."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from queuelens import catalog, session
from queuelens.operators.quantiles import values_at_ranks
from queuelens.plans import features as FP
from queuelens.sources import reports
from queuelens.sources.adapters import adapter_frames


def test_reports_raise_instead_of_cutting(spark):
    assert len(reports.format_rows(spark.range(1500)).split("\n")) == 1501
    with pytest.raises(ValueError):
        reports.format_rows(spark.range(11), max_rows=10)
    with pytest.raises(ValueError):
        reports.rows_as_dicts(spark.range(11), max_rows=10)


def test_report_paths_are_hadoop_paths(spark, tmp_path):
    target = f"file://{tmp_path}/deep/report.json"
    reports.write_json(target, {"a": 1})
    assert json.loads((tmp_path / "deep" / "report.json").read_text()) == {"a": 1}


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://x", "local-cluster[2,1,1024]"])
def test_cluster_master_needs_shared_folder(master):
    with pytest.raises(RuntimeError):
        session.local_scratch(master)


def test_label_varies_around_the_clip(spark):
    fr = adapter_frames(spark, SF_MID, ["task_events", "machine_events"])
    f = FP.build_features(fr["task_events"], fr["machine_events"], ["queue_delay_seconds"])
    n, below, values = f.agg(F.count("*"), F.count(F.when(F.col("queue_delay_seconds") < catalog.CLIP, 1)),
                             F.countDistinct("queue_delay_seconds")).first()
    assert 0.2 * n <= below <= 0.8 * n and 100 < values < n


def test_refined_ranks_on_large_groups(spark, monkeypatch):
    from queuelens.operators import quantiles

    monkeypatch.setattr(quantiles, "BINS", 16)
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.when(F.col("id") < 3000, F.lit(7200.0)).otherwise(
        F.pow(F.lit(1.01), F.col("id") % 997)).alias("v"))
    got = values_at_ranks(df, "v", lambda n: range(0, n, 37), ["g"])
    rows = {0: [], 1: []}
    for r in df.collect():
        rows[r.g].append(r.v)
    for (g,), (n, at) in got.items():
        want = sorted(rows[g])
        assert n == len(want) and all(want[k] == v for k, v in at.items())


def test_feature_plans_are_lazy_and_narrow(spark):
    fr = adapter_frames(spark, SF_MID, ["task_events", "machine_events"])
    plan = FP.build_features(fr["task_events"], fr["machine_events"], ["queue_delay_seconds", "split"])
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in text and "capacity" not in text
