"""Parallelism guard for CPU-heavy steps.

A table stored as one large row group scans as a single task, so numpy /
UDF / MLlib work downstream would run on one core.  ``ensure_parallelism``
adds a round-robin repartition only when the plan's inputs give fewer splits
than there are cores.  It never runs a job: splits are estimated from the
inputs' number of files and bytes (a file of 1 TB is thousands of splits),
and a checkpoint's partitions are known."""

from __future__ import annotations

from pyspark.sql import DataFrame


def estimated_splits(df: DataFrame) -> int:
    """Splits of the inputs of a plan, from file listings and sizes only."""
    spark = df.sparkSession
    split_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes"))
    leaves, total = df._jdf.queryExecution().analyzed().collectLeaves(), 0
    for i in range(leaves.length()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRDD":
            total += leaf.rdd().getNumPartitions()
        else:
            total += max(1, int(str(leaf.stats().sizeInBytes())) // split_bytes)
    return max(total, len(df.inputFiles()))


def ensure_parallelism(df: DataFrame, minimum: int | None = None) -> DataFrame:
    target = minimum or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if estimated_splits(df) < target else df


def dealt_by_bytes(df: DataFrame, key: str, part_bytes: int) -> DataFrame:
    """``df`` dealt by ``key`` into parts for about ``part_bytes`` of its inputs' stored
    bytes each (not fewer than there are cores), for steps that need much more memory
    than their input; small inputs stay as they are."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    total = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length()))
    parts = total // part_bytes
    return df.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism), key) if parts > 1 else df
