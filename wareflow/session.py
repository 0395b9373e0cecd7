"""A local session for tests and timings. On a cluster, pass the session you have."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


#: Settings that `prepare` turns on.
NEEDED = (
    "spark.sql.adaptive.enabled",
    "spark.sql.adaptive.skewJoin.enabled",
    "spark.sql.adaptive.forceOptimizeSkewedJoin",
)


#: A filter made from the wanted orders' keys is applied to the lines where they are scanned, before
#: they are shuffled, if the lines' scan has at least this size. Spark's own limit is ten times as much.
RUNTIME_FILTER = "spark.sql.optimizer.runtime.bloomFilter.enabled"
FILTERED_SCAN = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
SPARK_LIMIT, LIMIT = "10GB", "1GB"

#: A task after a shuffle sorts and hashes what it reads, in about twenty times the memory. Shuffles start with
#: this many partitions at least and adaptive execution merges them up to this size, so a task's share
#: doesn't grow with the input until a shuffle has more than both allow, 3.2 GB.
FIRST_PARTITIONS, LEAST_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "200"
TASK_READ, TASK_SHARE = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "16MB"


def missing_settings(spark: SparkSession) -> list[str]:
    """The settings the plans rely on that a session doesn't have."""
    return [key for key in NEEDED if spark.conf.get(key) != "true"]


def prepare(spark: SparkSession) -> SparkSession:
    """The adaptive settings the plans rely on, for any session.

    A key that holds a large part of the rows is split at run time, also where the next
    step could have used the join's partitioning and needs one more shuffle for it. Sizes and numbers of
    partitions that the session sets itself stay as they are.
    """
    for key in NEEDED:
        if spark.conf.get(key) != "true":
            spark.conf.set(key, "true")
    if spark.conf.get(RUNTIME_FILTER) != "true":
        spark.conf.set(RUNTIME_FILTER, "true")
    if spark.conf.get(FILTERED_SCAN) == SPARK_LIMIT:
        spark.conf.set(FILTERED_SCAN, LIMIT)
    if spark.conf.get(TASK_READ, None) is None:
        spark.conf.set(TASK_READ, TASK_SHARE)
    if spark.conf.get(FIRST_PARTITIONS, None) in (None, LEAST_PARTITIONS):
        if int(spark.conf.get("spark.sql.shuffle.partitions")) < int(LEAST_PARTITIONS):
            spark.conf.set(FIRST_PARTITIONS, LEAST_PARTITIONS)
        else:  # the shuffles have as many by themselves
            spark.conf.unset(FIRST_PARTITIONS)
    return spark


def local_session(name: str = "wareflow", cpus: int | None = None, **conf: str) -> SparkSession:
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
