"""Task events from one join: the rows of the SQL text, in parts whose number follows the bytes."""

import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from queuelens import catalog
from queuelens.plans import features as FP
from queuelens.session import scratch_path
from queuelens.sources import adapters, files, staged

LINES = ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_discount double, l_tax double, "
         "l_returnflag string, l_linestatus string, l_shipdate date")
ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate date, o_orderpriority string"


@pytest.fixture(scope="module")
def folder(spark):
    """Lines and orders with nulls in every column but the keys, null keys, and rows that come twice."""
    day = datetime.date(2001, 2, 3)
    lines = [(k % 40, k * 37, k * 11 % 53, 1 + k % 7, float(k % 50), k / 1000, k / 2000, "RAN"[k % 3], "FO"[k % 2], day) for k in range(400)]
    lines += [tuple(None if i == c else x for i, x in enumerate(lines[c])) for c in range(len(lines[0]))] + lines[:25]
    orders = [(k, k * 3, "O", day + datetime.timedelta(k), f"{1 + k % 5}-X") for k in range(45)]
    orders += [(k, None, None, None, None) for k in (7, 100)] + [(None, 1, "O", day, "1-X")] + orders[:3]
    out = scratch_path(spark, f"shop-{uuid.uuid4().hex}")
    spark.createDataFrame(lines, LINES).write.parquet(f"{out}/lineitem.parquet")
    spark.createDataFrame(orders, ORDERS).write.parquet(f"{out}/orders.parquet")
    other = {"supplier": "s_suppkey bigint, s_nationkey bigint, s_acctbal double", "nation": "n_nationkey bigint, n_name string",
             "part": "p_partkey bigint, p_brand string, p_size int"}
    for name, schema in other.items():
        spark.createDataFrame([], schema).write.parquet(f"{out}/{name}.parquet")
    return out


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("part_bytes", [8 << 20, 100])
def test_task_events_are_those_of_the_text(spark, folder, monkeypatch, part_bytes):
    monkeypatch.setattr(adapters, "PART_BYTES", part_bytes)
    base = adapters.base_frames(spark, folder)
    want = spark.sql(adapters._render(adapters.ADAPTER_SQL["task_events"], "spark"), lineitem=base["lineitem"], orders=base["orders"])
    got = adapters.adapter_frames(spark, folder, ["task_events"])["task_events"]
    assert got.dtypes == want.dtypes and got.count() == want.count() > 1200
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_parts_follow_the_bytes(spark, folder, monkeypatch):
    size = sum(files.size(spark, f"{folder}/{t}.parquet") for t in ("lineitem", "orders"))
    parts = []
    for n in (20, 80):
        monkeypatch.setattr(adapters, "PART_BYTES", -(-size // n))
        te = adapters.adapter_frames(spark, folder, ["task_events"])["task_events"]
        parts.append(te.rdd.getNumPartitions())
        plan = plan_of(FP.task_rollup(te))
        assert plan.count("FileScan") == plan.count("Exchange hashpartitioning") == 2       # none for the tasks themselves
    assert abs(parts[0] - 20) <= 1 and abs(parts[1] - 80) <= 4


def test_dealt_rows_are_staged_without_a_shuffle(spark, folder, monkeypatch):
    monkeypatch.setattr(adapters, "PART_BYTES", 500)
    te = adapters.adapter_frames(spark, folder, ["task_events"])["task_events"]
    n, named = adapters.event_parts(spark, folder)
    assert named
    path = scratch_path(spark, f"dealt-{uuid.uuid4().hex}.parquet")
    staged.stage(te, path, staged.KEYED["task_events"], dealt=n)
    written = [x for x, _ in files.sizes(spark, path) if x.endswith(".parquet")]
    assert len(written) == len({x.split("_")[-1] for x in written})          # one file per bucket
    again = staged.read_staged(spark, path)
    assert again.exceptAll(te).isEmpty() and te.exceptAll(again).isEmpty()
    assert "Exchange" not in plan_of(FP.task_rollup(again))
    assert FP.task_rollup(again).exceptAll(FP.task_rollup(te)).isEmpty()
    keys = catalog.QUERIES["feature_table_staged"](spark, folder).select("job_id", "task_index")
    assert keys.count() == keys.distinct().count() == FP.feature_base(FP.task_rollup(te)).count() > 0


def test_csv_is_written_compressed(spark):
    from queuelens.sources import csv

    out = scratch_path(spark, f"gz-{uuid.uuid4().hex}")
    df = spark.range(100).select(F.lit(0).cast("bigint").alias("timestamp"), F.col("id").alias("machine_id"), F.lit(0).alias("event_type"),
                                 F.lit("p, \"0\"").alias("platform_id"), F.lit(0.5).alias("capacity_cpu"), F.lit(None).cast("double").alias("capacity_memory"))
    csv.write_trace_csv(df, f"{out}/machine_events.csv")
    names = [n for n, _ in files.sizes(spark, f"{out}/machine_events.csv") if n.startswith("part-")]
    assert names and all(n.endswith(".csv.gz") for n in names)
    again = csv.read_machine_events(spark, out)
    assert again.exceptAll(df).isEmpty() and again.count() == 100
