"""Literal-row cases for the traps of the feature plan and the evaluators."""

import math

from pyspark.sql import functions as F

from conftest import MACHINE_EVENT_SCHEMA, TASK_EVENT_SCHEMA, ev, frame
from queuelens.functions.labels import to_seconds, to_training_label
from queuelens.functions.time import minute_bucket
from queuelens.operators.first_value import first_by, last_by
from queuelens.operators.stats import correlation_matrix, finish_metrics, histogram
from queuelens.plans import features as FP
from queuelens.plans import validation as VP


def _first(spark, rows):
    df = frame(spark, rows, "x int, t bigint")
    return df.agg(first_by(F.col("x"), F.col("t")).alias("v")).first()["v"]


def test_first_by_skips_null(spark):
    assert _first(spark, [(None, 1), (5, 2)]) == 5


def test_first_by_all_null(spark):
    assert _first(spark, [(None, 1), (None, 2)]) is None


def test_first_by_tie_takes_smallest(spark):
    assert _first(spark, [(7, 1), (5, 1)]) == 5


def test_last_by_tie_takes_largest(spark):
    df = frame(spark, [(7, 1), (5, 1), (3, 0), (None, 9)], "x int, t bigint")
    assert df.agg(last_by(F.col("x"), F.col("t")).alias("v")).first()["v"] == 7


def _features(spark, rows, machines=None):
    te = frame(spark, rows, TASK_EVENT_SCHEMA)
    me = frame(spark, machines or [(0, 1, 0, "p", 0.5, 0.25)], MACHINE_EVENT_SCHEMA)
    return {(r.job_id, r.task_index): r for r in FP.build_features(te, me).collect()}


def test_schedule_before_submit_dropped(spark):
    assert _features(spark, [ev(10, 1, 0, 0), ev(5, 1, 0, 1, machine=1)]) == {}


def test_zero_delay_kept(spark):
    out = _features(spark, [ev(10, 1, 0, 0), ev(10, 1, 0, 1, machine=1)])
    assert out[(1, 0)].queue_delay_seconds == 0.0


def test_submit_only_counted_in_job_task_count(spark):
    out = _features(spark, [ev(10, 1, 0, 0), ev(20, 1, 0, 1, machine=1), ev(10, 1, 1, 0)])
    assert set(out) == {(1, 0)}
    assert out[(1, 0)].job_task_count == 2


def test_null_job_id_has_no_row(spark):
    assert _features(spark, [ev(10, None, 0, 0), ev(20, None, 0, 1, machine=1)]) == {}


def test_resubmission_first_submit_and_minute_counts(spark):
    rows = [ev(10, 1, 0, 0), ev(50, 1, 0, 0), ev(60, 1, 0, 1, machine=1)]
    out = _features(spark, rows)
    assert out[(1, 0)].submit_ts == 10
    assert out[(1, 0)].submits_same_minute == 2
    assert out[(1, 0)].schedules_same_minute == 1
    assert out[(1, 0)].backlog_estimate == 1


def test_minute_edge(spark):
    df = frame(spark, [(59_999_999,), (60_000_000,)], "ts bigint")
    assert [r[0] for r in df.select(minute_bucket(F.col("ts"))).collect()] == [0, 1]


def test_machine_absent_gives_zero_capacity(spark):
    out = _features(spark, [ev(10, 1, 0, 0), ev(20, 1, 0, 1, machine=99)])
    assert out[(1, 0)].machine_cpu_capacity == 0.0
    assert out[(1, 0)].machine_memory_capacity == 0.0


def test_null_schedule_machine(spark):
    out = _features(spark, [ev(10, 1, 0, 0), ev(20, 1, 0, 1, machine=None)])
    assert out[(1, 0)].schedule_machine is None
    assert out[(1, 0)].machine_cpu_capacity == 0.0


def test_attribute_null_everywhere(spark):
    out = _features(spark, [ev(10, 1, 0, 0, cpu=None), ev(20, 1, 0, 1, machine=1)])
    r = out[(1, 0)]
    assert r.cpu_request == 0.0 and r.priority is None and r.request_sum == 0.0


def test_attributes_chosen_independently(spark):
    rows = [ev(10, 1, 0, 0, priority=None, cpu=0.5), ev(20, 1, 0, 1, machine=1, priority=3, cpu=0.9),
            ev(30, 1, 0, 4, dmc=True, missing=1)]
    r = _features(spark, rows)[(1, 0)]
    assert r.priority == 3 and r.cpu_request == 0.5
    assert r.different_machine_constraint == 1 and r.has_missing_info == 1


def test_latest_capacity_skips_null(spark):
    machines = [(0, 1, 0, "p", 0.5, 0.25), (5, 1, 2, "p", None, 0.75)]
    out = _features(spark, [ev(10, 1, 0, 0), ev(20, 1, 0, 1, machine=1)], machines)
    assert out[(1, 0)].machine_cpu_capacity == 0.5
    assert out[(1, 0)].machine_memory_capacity == 0.75


def test_invalid_event_types(spark):
    rows = [ev(1, 1, 0, t) for t in (None, -1, 0, 8, 9)]
    stats = VP.task_core_stats(frame(spark, rows, TASK_EVENT_SCHEMA)).first()
    assert stats.invalid_event_type_rows == 2
    assert stats.total_rows == 5 and stats.unique_tasks == 1 and stats.unique_jobs == 1


def test_distinct_tasks_keep_null_keys(spark):
    rows = [ev(1, 1, None, 0), ev(2, 1, None, 0), ev(3, None, 1, 0), ev(4, 2, 1, 0)]
    stats = VP.task_core_stats(frame(spark, rows, TASK_EVENT_SCHEMA)).first()
    assert stats.unique_tasks == 3 and stats.unique_jobs == 2


def test_priority_histogram_lowest_50_no_null(spark):
    rows = [ev(1, 1, 0, 0, priority=p) for p in range(51)] + [ev(1, 1, 0, 0, priority=None)]
    out = VP.priority_histogram(frame(spark, rows, TASK_EVENT_SCHEMA)).collect()
    assert [r.priority for r in out] == list(range(50))


def test_clip_and_log(spark):
    df = frame(spark, [(0.0,), (7200.0,), (9000.0,)], "y double")
    got = [r[0] for r in df.select(to_training_label(F.col("y"), 7200.0, True)).collect()]
    assert got == [math.log1p(0), math.log1p(7200), math.log1p(7200)]


def test_inverse_transform(spark):
    df = frame(spark, [(-1.0,), (0.0,), (20.0,)], "raw double")
    ev_ = [r[0] for r in df.select(to_seconds(F.col("raw"), 7200.0, True, floor_zero=True)).collect()]
    assert ev_ == [0.0, 0.0, 7200.0]
    tt = [r[0] for r in df.select(to_seconds(F.col("raw"), 7200.0, True, floor_zero=False)).collect()]
    assert tt[0] < 0 and tt[2] == 7200.0


def test_histogram_equal_values(spark):
    df = frame(spark, [(3.0,)] * 5, "v double")
    out = histogram(df, "v", 10).collect()
    nonempty = [r for r in out if r.rows]
    assert len(out) == 10 and len(nonempty) == 1 and nonempty[0].rows == 5
    assert nonempty[0].bin == 5


def test_histogram_max_in_last_bin(spark):
    df = frame(spark, [(0.0,), (1.0,), (10.0,)], "v double")
    rows = {r.bin: r.rows for r in histogram(df, "v", 10).collect()}
    assert rows[0] == 1 and rows[1] == 1 and rows[9] == 1 and sum(rows.values()) == 3


def test_correlation_constant_column_is_null(spark):
    df = frame(spark, [(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], "a double, b double")
    out = {(r.feature_a, r.feature_b): r.corr for r in correlation_matrix(df, ["a", "b"]).collect()}
    assert out[("a", "b")] is None and out[("b", "b")] == 1.0


def test_metrics_on_no_rows(spark):
    df = frame(spark, [], "y double, p double")
    r = F.col("p") - F.col("y")
    m = finish_metrics(df.agg(F.count("*").alias("rows"), F.sum(r * r).alias("sse"), F.sum(F.abs(r)).alias("sae"))).first()
    assert m.rows == 0 and m.rmse_seconds == 0.0 and m.mae_seconds == 0.0


def test_huge_timestamp_overflows_int_index(spark):
    import pytest

    rows = [ev(2**62, 1, 0, 0), ev(2**62 + 10, 1, 0, 1, machine=1)]
    with pytest.raises(Exception):
        _features(spark, rows)
