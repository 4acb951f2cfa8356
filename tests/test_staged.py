"""Staged tables: plans without shuffles on the key, one-scan totals, footers, row groups, head samples."""

import uuid

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, TASK_EVENT_SCHEMA, ev
from queuelens import catalog
from queuelens.plans import features as FP
from queuelens.plans import validation as VP
from queuelens.session import scratch_path
from queuelens.sources import files, parquet, staged
from queuelens.sources.adapters import adapter_frames


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return [line.split("Exchange ")[1].split(",")[0] for line in plan_of(df).splitlines()
            if "Exchange " in line and "Broadcast" not in line and "Reused" not in line]


@pytest.fixture(scope="module")
def paths(spark):
    return catalog.staged_raw(spark, SF_SMALL)


def test_no_shuffle_on_the_task_key(spark, paths):
    te = staged.read_staged(spark, paths["task_events"])
    assert exchanges(FP.task_rollup(te)) == []
    assert exchanges(FP.job_task_counts(te)) == []
    assert exchanges(FP.first_submit(te)) == [] and exchanges(FP.first_schedule(te)) == []
    joined = FP.feature_base(FP.task_rollup(te)).join(FP.job_task_counts(te), "job_id", "left")
    assert not [x for x in exchanges(joined) if "job_id" in x]
    merged = FP.feature_base(FP.task_rollup(te)).join(FP.job_task_counts(te).hint("merge"), "job_id", "left")
    assert "SortMergeJoin" in plan_of(merged) and "Exchange" not in plan_of(merged)
    assert exchanges(VP.task_core_stats(te)) == ["SinglePartition"]
    raw = adapter_frames(spark, SF_SMALL, ["task_events"])["task_events"]
    assert len(exchanges(FP.task_rollup(raw))) > 0


def test_staged_rows_are_the_tables(spark, paths):
    for name, df in adapter_frames(spark, SF_SMALL).items():
        again = staged.read_staged(spark, paths[name])
        assert again.columns == df.columns and again.exceptAll(df).isEmpty() and again.count() == df.count()


def test_skewed_bucket_is_read_plain(spark, monkeypatch):
    rows = [ev(t, 1 if t % 3 else t, t % 50, 0) for t in range(3000)]
    path = scratch_path(spark, f"skew-{uuid.uuid4().hex}.parquet")
    staged.stage(spark.createDataFrame(rows, TASK_EVENT_SCHEMA), path, staged.KEYED["task_events"], 16)
    assert exchanges(FP.task_rollup(staged.read_staged(spark, path))) == []
    monkeypatch.setattr(staged, "MIN_SKEWED", 0)
    monkeypatch.setattr(staged, "SKEW_FACTOR", 2)
    plain = FP.task_rollup(staged.read_staged(spark, path))
    assert len(exchanges(plain)) == 1 and plain.agg(F.sum("submit_events")).first()[0] == 3000


def test_totals_scan_once(spark, paths):
    plan = plan_of(VP.task_event_totals(staged.read_staged(spark, paths["task_events"])))
    assert plan.count("FileScan") == 1 and "Expand" in plan


def test_totals_give_the_sections(spark):
    rows = [ev(5, 1, 0, 0, priority=3, cpu=0.5), ev(7, 1, 0, 1, priority=None, missing=2), ev(9, None, None, 9), ev(None, 2, None, None, priority=3),
            ev(1, None, 4, 0, priority=11, disk=0.1)]
    for some in (rows, []):
        te = spark.createDataFrame(some, TASK_EVENT_SCHEMA)
        totals = VP.task_event_totals(te)
        assert sorted(VP.totals_core_stats(totals).columns) == sorted(VP.task_core_stats(te).columns)
        if some:
            cols = VP.task_core_stats(te).columns
            assert VP.totals_core_stats(totals).select(cols).collect() == VP.task_core_stats(te).collect()
        assert VP.totals_distribution(totals, "event_type").collect() == VP.task_event_distribution(te).collect()
        assert VP.totals_distribution(totals, "priority").limit(50).collect() == VP.priority_histogram(te).collect()


def test_ranges_come_from_footers(spark, paths):
    before = spark.conf.get("spark.sql.parquet.aggregatePushdown")
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    try:
        plan = plan_of(staged.read_columnar(spark, paths["task_usage"]).agg(F.count(F.lit(1)), F.min("start_time"), F.max("mean_cpu_usage_rate")))
    finally:
        spark.conf.set("spark.sql.parquet.aggregatePushdown", before)
    assert "PushedAggregation: [COUNT(*), MIN(start_time), MAX(mean_cpu_usage_rate)]" in plan
    assert "FileScan" in plan_of(spark.read.parquet(paths["task_usage"]))        # other reads keep the usual source


def test_columns_without_a_footer_range_are_scanned(spark):
    path = scratch_path(spark, f"nan-{uuid.uuid4().hex}")
    spark.createDataFrame([(1.0, None), (float("nan"), None), (0.0, None)], "x double, y double").coalesce(1).write.parquet(path)
    row = staged.footer_row(spark, path, F.min("x").alias("lo"), F.max("y").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    assert (row.lo, row.hi, row.n) == (0.0, None, 3)


def test_row_groups_have_their_rows(spark):
    path = scratch_path(spark, f"groups-{uuid.uuid4().hex}")
    df = spark.range(0, 50_000, 1, 1).select("id", F.lit("train").alias("split"))
    parquet.write_features(df, path, row_group_rows=20_000)
    found = files.sizes(spark, f"{path}/split=train")
    meta = [pq.ParquetFile(f"{path}/split=train/{n}").metadata for n, _ in found if n.endswith(".parquet")]
    assert [[m.row_group(i).num_rows for i in range(m.num_row_groups)] for m in meta] == [[20_000, 20_000, 10_000]]
    assert parquet.ROW_GROUP_ROWS == 2_000_000


def test_head_sample_in_file_order(spark):
    path = scratch_path(spark, f"head-{uuid.uuid4().hex}")
    spark.range(0, 1000, 1, 7).withColumn("x", F.col("id") * 2).write.parquet(path)
    order = [r for n, _ in sorted(files.sizes(spark, path)) if n.endswith(".parquet")
             for r in pq.read_table(f"{path}/{n}")["id"].to_pylist()]
    for cap in (0, 1, 142, 143, 500, 5000):
        df = parquet.head_sample(spark, path, ["id"], cap)
        assert sorted(r.id for r in df.collect()) == sorted(order[:cap])
    plan = plan_of(parquet.head_sample(spark, path, ["id"], 300))
    assert "Sort" not in plan and "Exchange hash" not in plan
    with pytest.raises(FileNotFoundError):
        parquet.head_sample(spark, path + "-none", ["id"], 5)
