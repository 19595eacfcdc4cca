"""Session settings the operators rely on, and the shared folder for written intermediates."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    # instants are UTC everywhere; local time is derived explicitly
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # merged partitions are measured compressed; sorted keys and constant structs are about 20 times that in a task
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # keep join salting effective: never co-partition on a subset of the join keys
    "spark.sql.requireAllClusterKeysForCoPartition": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # streaming state on local disk instead of the executors' heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


# fixed at start-up; call-site capture makes every column expression slower to build
STATIC_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def build_session(app_name: str = "adloom", master: str | None = None, **extra: str) -> SparkSession:
    """Create (or fetch) a session; sizing is left to the cluster's own configuration."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **STATIC_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime-settable part of the settings to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared checkpoint folder named by the cluster.

    There is no fallback: a folder that only one machine sees would lose data on a cluster.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and every executor can reach")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
