import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from queuelens.session import build_session

    s = build_session("local[4]", shuffle_partitions=8, app_name="queuelens-tests")
    yield s
    s.stop()


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


TASK_EVENT_SCHEMA = (
    "timestamp bigint, missing_info bigint, job_id bigint, task_index bigint, machine_id bigint, "
    "event_type int, user_name string, scheduling_class int, priority int, cpu_request double, "
    "ram_request double, disk_request double, different_machine_constraint boolean"
)
MACHINE_EVENT_SCHEMA = ("timestamp bigint, machine_id bigint, event_type int, platform_id string, "
                        "capacity_cpu double, capacity_memory double")


def ev(ts, job, task, etype, machine=None, priority=None, cpu=None, ram=None, disk=None,
       cls=None, dmc=None, missing=None):
    return (ts, missing, job, task, machine, etype, None, cls, priority, cpu, ram, disk, dmc)
