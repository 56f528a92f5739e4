"""Applying fitted scorers to a stream.

The reference has no streaming.  Every scorer here is stateless per row once
fitted (z-score statistics, the random forest pipeline, the isolation-forest
node table), so a ``readStream`` frame can be scored with the same column
expressions as a batch frame; nothing here keeps state across micro-batches.
``foreachBatch`` writes each scored micro-batch with the batch writer, which
is idempotent per batch id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.exprs import number


@dataclass
class ZScoreStats:
    """Mean and sample std of the amount, fitted once on a batch table."""
    column: str
    mean: float
    std: float | None

    @classmethod
    def fit(cls, df: DataFrame, column: str) -> "ZScoreStats":
        r = df.agg(F.avg(number(column)).alias("m"), F.stddev_samp(number(column)).alias("s")).first()
        return cls(column, r["m"], r["s"])


def flag_outliers(stream: DataFrame, stats: ZScoreStats) -> DataFrame:
    """ANO-1 applied row by row with fixed statistics (works on batch and stream)."""
    z = F.abs(F.try_divide(number(stats.column) - F.lit(stats.mean), F.lit(stats.std)))
    z = F.when(~F.isnan(z), z)
    return stream.withColumn("z_score", z).withColumn(
        "is_outlier", F.coalesce(z > C.ZSCORE_THRESHOLD, F.lit(False))).withColumn(
        "severity", F.when(z > C.ZSCORE_HIGH, "high").when(z > C.ZSCORE_THRESHOLD, "medium"))


def write_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def write_batches(scored: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Write every micro-batch to its own folder of the parquet table at
    ``path``, so a batch that is replayed after a failure replaces itself;
    progress is kept in ``checkpoint`` (a folder in the shared storage)."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, path)

    w = scored.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if once else w
    return w.start()
