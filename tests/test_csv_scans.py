"""Headerless CSV scans under the fixed schemas."""

import os
import tempfile

import pytest

from queuelens.sources import csv as C

GOOD = """0,,3418309,0,4155527081,0,userA,3,9,0.125,0.07446,0.0004244,0
0,2,3418309,1,,0,userA,3,9,,,,1
600000000,,3418309,0,4155527081,1,,3,9,0.125,0.07446,0.0004244,
600000001,,3418309,2,4155527081,1,"",3,9,0.125,0.07446,0.0004244,
"""


def _write(text, name="task_events.csv"):
    d = tempfile.mkdtemp(prefix="ql-csv-")
    with open(os.path.join(d, name), "w") as fh:
        fh.write(text)
    return d


def test_task_events_values(spark):
    d = _write(GOOD)
    rows = C.read_task_events(spark, d).collect()
    assert [r.missing_info for r in rows] == [None, 2, None, None]
    assert rows[1].machine_id is None
    assert [r.different_machine_constraint for r in rows] == [False, True, None, None]
    assert rows[3].user_name is None            # quoted empty string is NULL
    assert rows[0].machine_id == 4155527081 and rows[0].cpu_request == 0.125
    assert len(C.read_task_events(spark, d).columns) == 13


@pytest.mark.parametrize("bad", [
    "0,,1,0,1,0,u,3,9,0.1,0.1\n",                       # too few fields
    "0,,1,0,1,0,u,3,9,0.1,0.1,0.1,0,extra\n",           # too many fields
    "0,,1,0,1,zero,u,3,9,0.1,0.1,0.1,0\n",              # word in a numeric column
    "9223372036854775808,,1,0,1,0,u,3,9,0.1,0.1,0.1,0\n",  # above 2^63-1: fails, never wraps
])
def test_malformed_rows_fail(spark, bad):
    d = _write(GOOD + bad)
    with pytest.raises(Exception):
        C.read_task_events(spark, d).collect()
    with pytest.raises(Exception):          # no column that is asked for is malformed
        C.read_task_events(spark, d).select("job_id").collect()


def test_register_views(spark):
    d = tempfile.mkdtemp(prefix="ql-csv-")
    lines = {
        "task_events": GOOD,
        "job_events": "0,,1,0,u,1,j,lj\n",
        "machine_events": "0,5,0,p,0.5,0.25\n",
        "machine_attributes": "0,5,name,val,1\n",
        "task_constraints": "0,1,0,name,val,2\n",
        "task_usage": ",".join(["1"] * 5 + ["0.5"] * 13 + ["1", "0.5"]) + "\n",
    }
    for t, text in lines.items():
        with open(os.path.join(d, f"{t}.csv"), "w") as fh:
            fh.write(text)
    frames = C.register_views(spark, d)
    assert spark.sql("select count(*) from task_events").first()[0] == 4
    assert frames["machine_attributes"].first().attribute_deleted is True
    assert frames["task_usage"].first().aggregation_type == 1


def test_csv_round_trip_gives_same_features(spark):
    """Raw-CSV path (S1-S7) -> feature table equals the in-memory path."""
    from conftest import SF_SMALL
    from queuelens.plans import features as FP
    from queuelens.sources.adapters import adapter_frames

    frames = adapter_frames(spark, SF_SMALL, ["task_events", "machine_events"])
    d = tempfile.mkdtemp(prefix="ql-csvrt-")
    for name, df in frames.items():
        C.write_trace_csv(df, f"{d}/{name}.csv")
    te, me = C.read_task_events(spark, d), C.read_machine_events(spark, d)
    assert [(f.name, f.dataType) for f in te.schema.fields] == \
        [(f.name, f.dataType) for f in frames["task_events"].schema.fields]
    a = sorted(map(tuple, FP.build_features(te, me).collect()))
    b = sorted(map(tuple, FP.build_features(frames["task_events"], frames["machine_events"]).collect()))
    assert len(a) > 2000 and a == b
