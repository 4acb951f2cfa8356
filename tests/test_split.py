"""The split hash on keys of every size, and whole fixtures on which filters, joins, floors and caps act."""

import math
import random

import duckdb
from pyspark.sql import functions as F

from conftest import SF_MID
from queuelens import catalog
from queuelens.functions.split import MULTIPLIER, hash_bucket, hash_halves
from queuelens.plans import evaluation as EV
from queuelens.plans import features as FP
from queuelens.plans import validation as VP
from queuelens.sources.adapters import adapter_frames, base_frames


def _plain(x):
    for _ in range(2):
        x = (x ^ (x >> 32)) * MULTIPLIER % 2**64
    return x ^ (x >> 32)


def test_hash_of_every_key_size(spark):
    rnd = random.Random(5)
    keys = sorted({0, 1, 2**31, 2**32 - 1, 2**32, 2**53 + 1, 2**63 - 1, *(rnd.randrange(2 ** rnd.randint(1, 63)) for _ in range(2000))})
    frame = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r[0]: (r[1] * 2**32 + r[2], r[3], r[4])
           for r in frame.select("k", *hash_halves(F.col("k")), hash_bucket(F.col("k")), hash_bucket(F.col("k"), 7)).collect()}
    assert got == {k: (_plain(k), _plain(k) % 100, _plain(k) % 7) for k in keys}
    assert sum(k > 2**53 for k in keys) > 200
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k UBIGINT)")
    con.executemany("INSERT INTO t VALUES (?)", [(k,) for k in keys])
    assert {k: (h, b) for k, h, b in con.sql("SELECT k, hash(k), abs(hash(k)) % 100 FROM t").fetchall()} == {
        k: v[:2] for k, v in got.items()}


def test_hash_stays_in_generated_code(spark):
    plan = spark.range(10).select(hash_bucket(F.col("id")))._jdf.queryExecution().executedPlan().toString()
    assert "*(1) Project" in plan and "BatchEvalPython" not in plan


def test_every_line_is_a_whole_task(spark):
    """No event, task or job of the test tables is left out."""
    base = base_frames(spark, SF_MID)
    lines = base["lineitem"].join(base["orders"], F.col("l_orderkey") == F.col("o_orderkey")).cache()
    n, tasks, jobs = lines.count(), lines.select("l_orderkey", "l_linenumber").distinct().count(), lines.select("l_orderkey").distinct().count()
    events = catalog.QUERIES["task_event_distribution"](spark, SF_MID).collect()
    assert sum(r.rows for r in events) == 3 * n and [r.rows for r in events if r.event_type in (0, 1)] == [n, n]
    assert sum(r.rows for r in VP.priority_histogram(catalog.task_events(spark, SF_MID), 1000).collect()) == 3 * n
    for name in ("first_submit", "submit_schedule_join", "machine_capacity_join", "request_sum"):
        assert catalog.QUERIES[name](spark, SF_MID).count() == tasks, name
    counts = catalog.QUERIES["job_task_counts"](spark, SF_MID)
    assert counts.agg(F.count("*"), F.sum("job_task_count")).first() == (jobs, tasks)
    lines.unpersist()


def test_filters_and_joins_act_on_misses(spark):
    """Each of J1, P4 drops its rows: tasks without a submit or a schedule, and early schedules."""
    whole = adapter_frames(spark, SF_MID, ["task_events"])["task_events"]
    kind, et = F.pmod(F.xxhash64("job_id", "task_index"), F.lit(16)), F.col("event_type")
    events = whole.where(~((kind == 0) & (et == 0)) & ~((kind == 1) & (et == 1))).withColumn(
        "timestamp", F.when((kind == 2) & (et == 1), F.lit(0)).otherwise(F.col("timestamp")))
    tasks = {r.kind: r.n for r in whole.select("job_id", "task_index", kind.alias("kind")).distinct().groupBy("kind").agg(F.count("*").alias("n")).collect()}
    rollup = FP.task_rollup(events).cache()
    lone = rollup.select(F.count_if(F.col("submit_events") == 0), F.count_if(F.col("schedule_events") == 0)).first()
    assert lone == (tasks[0], tasks[1]) and min(lone) > 0
    n = sum(tasks.values())
    assert rollup.count() == n and FP.submit_schedule_pairs(rollup).count() == n - tasks[0] - tasks[1]
    assert FP.feature_base(rollup).count() == n - tasks[0] - tasks[1] - tasks[2]
    rollup.unpersist()


def test_fixture_makes_floor_and_caps_act(spark):
    """P20's floor and each of P19's caps change at least 5 % of the stand-in's rows."""
    f = catalog.stored_features(spark, SF_MID)
    clip, n = catalog.CLIP, f.count()
    p = EV.standin_predictions(f, clip, log1p_target=True)
    capped = p.where(F.col("raw") > math.log1p(clip)).count()
    s = EV.scored(p, clip, True)
    floored = s.where(F.col("pred") != F.col("pred_train_time")).count()
    plain = EV.standin_predictions(f, clip, log1p_target=False)
    assert min(capped, floored, plain.where(F.col("raw") > clip).count()) >= 0.05 * n
    assert s.where("pred < 0").isEmpty()
