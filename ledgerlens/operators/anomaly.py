"""Statistical anomaly detection (ANO-1..5).

Global statistics are one-row aggregates joined back with a broadcast of that
single row (never an unpartitioned window).  Over-active customers are found
with a two-level aggregate; their member rows are returned as a row-level
table (semi-join), not as an in-row list, so a customer that owns a third of
the table never becomes one giant array in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import amount_column, customer_column, id_type
from ..functions.exprs import number
from ..session import stored

RECORD_COLUMNS = ["type", "severity", "reason", "subject", "row_id", "n_rows"]


def _id_type(df: DataFrame, row_id: str) -> str:
    return id_type(df, row_id) if row_id in df.columns else "bigint"


def _empty_records(df: DataFrame, row_id: str = "transaction_id") -> DataFrame:
    return df.sparkSession.createDataFrame([], "type string, severity string, reason string, subject string, "
                                               f"row_id {_id_type(df, row_id)}, n_rows bigint")


def _amount_z(df: DataFrame, amount_col: str) -> tuple[DataFrame, F.Column]:
    """|z| per row.  NaN amounts are missing (they enter no statistic); with an
    infinite amount the statistics are not numbers and no row has a z, as in
    pandas.  Never NaN, which Spark would order above every threshold."""
    x = number(amount_col)
    stats = df.agg(F.avg(x).alias("_z_mean"), F.stddev_samp(x).alias("_z_std"))
    joined = df.crossJoin(F.broadcast(stats))
    z = F.abs(F.try_divide(x - F.col("_z_mean"), F.col("_z_std")))
    return joined, F.when(~F.isnan(z), z)


def zscore_outliers(df: DataFrame, row_id: str = "transaction_id", amount_col: str | None = None,
                    threshold: float = C.ZSCORE_THRESHOLD, high: float = C.ZSCORE_HIGH) -> DataFrame:
    """ANO-1: rows whose |z| (sample std) is strictly above ``threshold``."""
    amount_col = amount_col or amount_column(df, C.AMOUNT_CANDIDATES_ANOMALY)
    if amount_col is None:
        return _empty_records(df, row_id).withColumn("amount", F.lit(None).cast("double")) \
            .withColumn("z_score", F.lit(None).cast("double"))
    joined, z = _amount_z(df, amount_col)
    x = F.col(amount_col)
    return (joined.select(F.col(row_id).cast(id_type(df, row_id)).alias("row_id"), x.cast("double").alias("amount"),
                          z.alias("z_score"))
            .where(F.col("z_score") > threshold)
            .select(F.lit("statistical_outlier").alias("type"),
                    F.when(F.col("z_score") > high, "high").otherwise("medium").alias("severity"),
                    F.format_string("Amount %.2f is %.2f standard deviations from mean",
                                    F.col("amount"), F.col("z_score")).alias("reason"),
                    F.lit(None).cast("string").alias("subject"),
                    "row_id", F.lit(1).cast("bigint").alias("n_rows"), "amount", "z_score"))


def customer_counts(df: DataFrame, customer_col: str) -> DataFrame:
    return (df.where(F.col(customer_col).isNotNull())
            .groupBy(customer_col).agg(F.count(F.lit(1)).alias("n_rows")))


def unusual_customers(df: DataFrame, customer_col: str | None = None,
                      sigmas: float = C.FREQUENCY_SIGMAS) -> DataFrame:
    """Customers whose row count is strictly above mean + sigmas * sample std
    of the per-customer counts.  Columns: customer, n_rows, mean_rows."""
    customer_col = customer_col or customer_column(df)
    counts = customer_counts(df, customer_col)
    stats = counts.agg(F.avg("n_rows").alias("mean_rows"), F.stddev_samp("n_rows").alias("std_rows"))
    return (counts.crossJoin(F.broadcast(stats))
            .where(F.col("n_rows") > F.col("mean_rows") + sigmas * F.col("std_rows"))
            .select(F.col(customer_col).alias("customer"), "n_rows", "mean_rows"))


def frequency_outliers(df: DataFrame, customer_col: str | None = None,
                       sigmas: float = C.FREQUENCY_SIGMAS, row_id: str = "transaction_id") -> DataFrame:
    """ANO-2: one record per over-active customer."""
    customer_col = customer_col or customer_column(df)
    if customer_col is None:
        return _empty_records(df, row_id)
    u = unusual_customers(df, customer_col, sigmas)
    subject = F.col("customer").cast("string")
    return u.select(F.lit("high_frequency").alias("type"), F.lit("medium").alias("severity"),
                    F.format_string("Customer %s has %d transactions (mean: %.1f)",
                                    subject, F.col("n_rows"), F.col("mean_rows")).alias("reason"),
                    subject.alias("subject"), F.lit(None).cast(_id_type(df, row_id)).alias("row_id"),
                    F.col("n_rows").cast("bigint").alias("n_rows"))


def frequency_rows(df: DataFrame, row_id: str = "transaction_id", customer_col: str | None = None,
                   sigmas: float = C.FREQUENCY_SIGMAS) -> DataFrame:
    """ANO-2 membership: the rows of each over-active customer (row_id, subject)."""
    customer_col = customer_col or customer_column(df)
    u = stored(unusual_customers(df, customer_col, sigmas).select(F.col("customer").alias(customer_col)), "unusual")
    return (df.join(u, customer_col, "left_semi")
            .select(F.col(row_id).cast(id_type(df, row_id)).alias("row_id"),
                    F.col(customer_col).cast("string").alias("subject")))


def anomaly_records(df: DataFrame, row_id: str = "transaction_id") -> DataFrame:
    """ANO-3: both record kinds in one schema."""
    z = zscore_outliers(df, row_id).select(*RECORD_COLUMNS)
    f = frequency_outliers(df, row_id=row_id)
    return z.unionByName(f)


def flag_anomalies(df: DataFrame, row_id: str = "transaction_id", amount_col: str | None = None,
                   customer_col: str | None = None) -> DataFrame:
    """ANO-4: the input rows plus ``is_anomaly`` (outlier row or row of an
    over-active customer).  The customer set is stored and joined without a hint:
    it is broadcast if its true size is small, else a customer who owns much of
    the table is split by adaptive skew handling."""
    amount_col = amount_col or amount_column(df, C.AMOUNT_CANDIDATES_ANOMALY)
    customer_col = customer_col or customer_column(df)
    out = df
    flag = F.lit(False)
    if amount_col is not None:
        joined, z = _amount_z(df, amount_col)
        out = joined.withColumn("_is_out", F.coalesce(z > C.ZSCORE_THRESHOLD, F.lit(False))) \
            .drop("_z_mean", "_z_std")
        flag = flag | F.col("_is_out")
    if customer_col is not None:
        u = stored(unusual_customers(df, customer_col).select(
            F.col("customer").alias(customer_col), F.lit(True).alias("_is_freq")), "unusual")
        out = out.join(u, customer_col, "left")
        flag = flag | F.coalesce(F.col("_is_freq"), F.lit(False))
    cols = [F.col(c) for c in df.columns]
    return out.select(*cols, flag.alias("is_anomaly"))


def anomaly_count(records: DataFrame) -> DataFrame:
    """ANO-5: number of anomaly records of a run."""
    return records.agg(F.count(F.lit(1)).alias("count"))
