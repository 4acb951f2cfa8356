"""Spark session defaults for the engine.

Cluster deployments pass their own conf (spark-submit / defaults file); the
knobs below are the ones the plans rely on and are only filled in when the
cluster conf does not set them.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings the plans are designed around. AQE re-plans joins from measured
# shuffle sizes (broadcast demotion, skew splitting, partition coalescing).
ENGINE_CONF: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcast decided on measured (not estimated) sizes of finished stages.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def build_session(
    master: str | None = None,
    app_name: str = "queuelens",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the engine defaults applied."""
    from pyspark import SparkConf

    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    given = SparkConf()             # includes spark-submit --conf / defaults file
    conf = {k: v for k, v in ENGINE_CONF.items() if not given.contains(k)}
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})   # explicit arguments win
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this conf must point at shared storage; it is only read, and
    an unset one raises. With a local master (tests) a fresh scratch folder is
    created instead.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = local_scratch(spark.sparkContext.master)
        spark.conf.set("spark.checkpoint.dir", configured)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def local_scratch(master: str) -> str:
    """A scratch folder for a local master; raises for any other."""
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"spark.checkpoint.dir is not set; master {master} needs a folder all executors share")
    return tempfile.mkdtemp(prefix="queuelens-ckpt-")


_OWNED: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediates."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    if _OWNED:
        _OWNED[-1].append(path)
    return path


@contextmanager
def owned_scratch(spark: SparkSession) -> Iterator[None]:
    """Own the scratch paths handed out inside the block, and delete them at its end."""
    from queuelens.sources.files import delete

    _OWNED.append([])
    try:
        yield
    finally:
        for path in reversed(_OWNED.pop()):
            delete(spark, path)
