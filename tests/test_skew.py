"""Hot keys: one job (and its tasks) holding a third of all events.

Broadcast joins are switched off and AQE skew thresholds lowered, so the
sort-merge and skew-split paths run; the result must equal the DuckDB oracle
over the same rows.
"""

import duckdb
from pyspark.sql import functions as F

from conftest import SF_SMALL
from queuelens import oracle as O
from queuelens.plans import features as FP
from queuelens.sources.adapters import adapter_frames

CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
}


def test_hot_job_features_match_oracle(spark):
    old = {k: spark.conf.get(k, None) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    try:
        fr = adapter_frames(spark, SF_SMALL, ["task_events", "machine_events"])
        te = fr["task_events"].withColumn(
            "job_id", F.when(F.col("job_id") % 3 == 0, F.lit(1).cast("bigint")).otherwise(F.col("job_id")))
        got = FP.build_features(te, fr["machine_events"])
        srows = sorted(tuple(r) for r in got.collect())
        con = duckdb.connect()
        con.register("task_events", te.toPandas())
        con.register("machine_events", fr["machine_events"].toPandas())
        body = ",".join([O.TASK_CTES, O.LOAD_CTES, O.SIDE_CTES, O.FEATURE_CTES])
        drows = sorted(con.sql("WITH " + body + "\nSELECT * FROM features").fetchall())
        assert len(srows) == len(drows) > 0
        assert any(r[0] == 1 for r in srows)          # the hot job has feature rows
        assert srows == drows
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
