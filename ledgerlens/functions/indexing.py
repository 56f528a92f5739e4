"""Sorted value dictionaries (value -> 0-based code) built without a
single-partition window over an unbounded set.

Small dictionaries (size checked first) are ranked in one task; larger ones
are range-sorted, checkpointed so the partitioning is fixed, and numbered by
per-partition offsets (the zipWithIndex scheme, expressed on DataFrames)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

from ..config import LIMITS


def sorted_dictionary(values: DataFrame, value_col: str = "value", code_col: str = "code",
                      local_limit: int | None = None) -> tuple[DataFrame, int]:
    """``values`` holds one column ``value_col``; returns (distinct values with
    their rank in ascending order as ``code_col`` (bigint), number of values).
    The dictionary is checkpointed, so it is computed once and survives the
    loss of the executors that built it."""
    local_limit = LIMITS.dictionary_local if local_limit is None else local_limit
    distinct = values.select(value_col).where(F.col(value_col).isNotNull()).distinct()
    n = distinct.count()
    if n <= local_limit:
        w = Window.orderBy(value_col)   # one task, bounded by the size check above
        dic = distinct.select(value_col, (F.row_number().over(w) - 1).cast("bigint").alias(code_col))
        ensure_checkpoint_dir(values.sparkSession)
        return dic.checkpoint(eager=True), n
    ensure_checkpoint_dir(values.sparkSession)
    ordered = distinct.orderBy(value_col).checkpoint(eager=True)
    tagged = ordered.select(value_col, F.spark_partition_id().alias("_pid"),
                            F.monotonically_increasing_id().alias("_mid"))
    sizes = sorted((r["_pid"], r["n"]) for r in
                   tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, acc = [], 0
    for pid, cnt in sizes:
        offsets.append((pid, acc))
        acc += cnt
    off = values.sparkSession.createDataFrame(offsets, "_pid int, _off long")
    low_bits = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    dic = (tagged.join(F.broadcast(off), "_pid")
           .select(value_col, (F.col("_off") + low_bits).cast("bigint").alias(code_col)))
    return dic, n


def prefix_sums(df: DataFrame, order_col: str, value_cols: list[str], local_limit: int | None = None,
                suffix: str = "_before", rows_per_partition: int | None = None) -> DataFrame:
    """For rows with distinct ``order_col`` values, add ``{v}{suffix}`` = sum
    of ``v`` over all rows with a smaller ``order_col``.

    Up to ``local_limit`` rows this is one ordered window (bounded by the
    check).  Beyond it the rows are range-partitioned and checkpointed, each
    partition computes its own running sums, and per-partition totals
    (one row per partition) give the offsets: no task ever sees more than
    one range partition."""
    local_limit = LIMITS.prefix_local if local_limit is None else local_limit
    rows_per_partition = LIMITS.prefix_rows_per_partition if rows_per_partition is None else rows_per_partition
    n = df.count()
    if n <= local_limit:
        w = Window.orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"{v}{suffix}")
                               for v in value_cols])
    ensure_checkpoint_dir(df.sparkSession)
    parts = max(2, -(-n // rows_per_partition))
    ordered = df.repartitionByRange(parts, order_col).checkpoint(eager=True) \
        .withColumn("_pid", F.spark_partition_id())
    totals = sorted((r["_pid"], [float(r[v] or 0) for v in value_cols]) for r in
                    ordered.groupBy("_pid").agg(*[F.sum(v).alias(v) for v in value_cols]).collect())
    offs, acc = [], [0.0] * len(value_cols)
    for pid, sums in totals:
        offs.append((pid, *acc))
        acc = [a + s for a, s in zip(acc, sums)]
    off = df.sparkSession.createDataFrame(
        offs, "_pid int, " + ", ".join(f"_o{i} double" for i in range(len(value_cols))))
    w = Window.partitionBy("_pid").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    return (ordered.join(F.broadcast(off), "_pid")
            .select(*[F.col(c) for c in df.columns],
                    *[(F.coalesce(F.sum(v).over(w), F.lit(0)) + F.col(f"_o{i}")).alias(f"{v}{suffix}")
                      for i, v in enumerate(value_cols)]))
