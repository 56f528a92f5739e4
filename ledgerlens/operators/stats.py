"""Aggregations and summaries (AGG-1..8, AGG-12).

Everything is one grouped or global aggregate; the only values that reach
the driver are single statistics rows and the exact quantiles (which are
computed without gathering a column, see ``functions.quantiles``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import (amount_column, category_column, first_temporal, numeric_columns,
                                 stats_label_column, temporal_columns)
from ..functions.exprs import measured, number
from ..functions.quantiles import quantiles

DESCRIBE_STATS = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]


def dataset_stats(df: DataFrame, records: DataFrame) -> DataFrame:
    """AGG-1: rows, anomaly records, records per row, column list."""
    n = df.agg(F.count(F.lit(1)).alias("total_transactions"))
    a = records.agg(F.count(F.lit(1)).alias("total_anomalies"))
    return n.crossJoin(a).select(
        "total_transactions", "total_anomalies",
        F.coalesce(F.try_divide(F.col("total_anomalies").cast("double"), F.col("total_transactions")),
                   F.lit(0.0)).alias("anomaly_rate"),
        F.lit(",".join(df.columns)).alias("columns"))


def epoch_micros(df: DataFrame, c: str):
    """A timestamp as integer microseconds since 1970 (time-zone independent
    for NTZ); integer, so sums and means stay exact."""
    from pyspark.sql import types as T
    if isinstance(df.schema[c].dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{c}`)")
    return F.unix_micros(F.col(c).cast("timestamp"))


def describe_numeric(df: DataFrame, cols: list[str] | None = None, timestamps: bool = True, rank_error: float | None = None) -> DataFrame:
    """AGG-2: count, mean, std (sample), min, quartiles (exact, linear), max
    per numeric column, in long form (column, stat, value).  Timestamp
    columns are described too (as pandas 2 does), in epoch seconds, with no
    std.  With a ``rank_error`` the quartiles come from one pass with that error."""
    cols = cols if cols is not None else numeric_columns(df)
    tcols = temporal_columns(df) if timestamps and cols == numeric_columns(df) else []
    if tcols:
        df = df.select(*[F.col(c) for c in cols], *[epoch_micros(df, c).alias(c) for c in tcols])
        cols = cols + tcols
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column string, stat string, value double")
    df = df.select(*[measured(df, c).alias(c) for c in cols])
    row = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.count(c).cast("double").alias(f"n{i}"),
        (F.avg(F.col(c).cast("decimal(38,0)")).cast("double") if c in tcols else F.avg(c)).alias(f"m{i}"),
        F.stddev_samp(c).alias(f"s{i}"), F.min(c).cast("double").alias(f"lo{i}"),
        F.max(c).cast("double").alias(f"hi{i}"))]).first()
    qs = quantiles(df, [(c, q) for c in cols for q in (0.25, 0.5, 0.75)], rank_error)
    rows = []
    for i, c in enumerate(cols):
        vals = [row[f"n{i}"], row[f"m{i}"], row[f"s{i}"], row[f"lo{i}"],
                qs[(c, 0.25)], qs[(c, 0.5)], qs[(c, 0.75)], row[f"hi{i}"]]
        if c in tcols:   # epoch seconds (from exact integer microseconds); no std for timestamps
            vals = [v if (i == 0 or v is None) else (None if i == 2 else v / 1e6) for i, v in enumerate(vals)]
        rows += [(c, s, float(v) if v is not None else None) for s, v in zip(DESCRIBE_STATS, vals)]
    return spark.createDataFrame(rows, "column string, stat string, value double")


def fraud_stats(df: DataFrame, label_col: str | None = None) -> DataFrame:
    """AGG-3: count and rate of the first column whose name has 'fraud'."""
    label_col = label_col or stats_label_column(df)
    if label_col is None:
        return df.sparkSession.createDataFrame([], "fraud_count bigint, fraud_rate double")
    y = F.col(label_col).cast("double")
    return df.agg(F.sum(y).cast("bigint").alias("fraud_count"), F.avg(y).alias("fraud_rate"))


def amount_profile(df: DataFrame, amount_col: str | None = None, rank_error: float | None = None) -> DataFrame:
    """AGG-4: total, mean, median (exact unless a ``rank_error`` is given), max, min of the amount."""
    amount_col = amount_col or amount_column(df, C.AMOUNT_CANDIDATES_TRENDS)
    df = df.select(measured(df, amount_col).alias(amount_col))
    med = quantiles(df, [(amount_col, 0.5)], rank_error)[(amount_col, 0.5)]
    x = F.col(amount_col)
    return df.agg(F.sum(x).alias("total_volume"), F.avg(x).alias("average_transaction"),
                  F.max(x).cast("double").alias("max_transaction"),
                  F.min(x).cast("double").alias("min_transaction")) \
        .withColumn("median_transaction", F.lit(med).cast("double"))


def py_ts_text(c):
    """``str(pandas.Timestamp)``: microseconds shown only when non-zero."""
    micros = F.unix_micros(c.cast("timestamp")) % 1_000_000
    return F.when(micros == 0, F.date_format(c, "yyyy-MM-dd HH:mm:ss")) \
        .otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def date_range(df: DataFrame, date_col: str | None = None) -> DataFrame:
    """AGG-5: first and last timestamp, as text."""
    date_col = date_col or first_temporal(df)
    d = F.col(date_col)
    return df.agg(F.min(d).alias("s"), F.max(d).alias("e")).select(
        py_ts_text(F.col("s")).alias("start"), py_ts_text(F.col("e")).alias("end"))


def daily_volume(df: DataFrame, date_col: str | None = None, amount_col: str | None = None) -> DataFrame:
    """AGG-6: amount per calendar day; rows without a date are left out, a day
    without amounts has 0."""
    date_col = date_col or first_temporal(df)
    amount_col = amount_col or amount_column(df, C.AMOUNT_CANDIDATES_TRENDS)
    return (df.select(F.to_date(date_col).alias("day"), number(amount_col).alias("x")).where("day IS NOT NULL")
            .groupBy("day").agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("volume")))


def daily_peak(df: DataFrame, date_col: str | None = None, amount_col: str | None = None) -> DataFrame:
    """AGG-7: mean daily volume, the peak day (earliest on a tie) and its volume."""
    d = daily_volume(df, date_col, amount_col)
    return d.agg(F.avg("volume").alias("daily_average"),
                 F.min_by("day", F.struct((-F.col("volume")).alias("nv"), F.col("day").alias("dd")))
                 .alias("peak"), F.max("volume").alias("peak_volume")) \
        .select("daily_average", F.date_format("peak", "yyyy-MM-dd").alias("peak_day"), "peak_volume")


def top_categories(df: DataFrame, n: int = C.TOP_CATEGORIES, cat_col: str | None = None,
                   amount_col: str | None = None) -> DataFrame:
    """AGG-8: the n categories with the largest total amount (a top-k report:
    per-partition top-n then one merge, ``TakeOrderedAndProject``).  Rows without
    a category are left out, as pandas' groupby does."""
    cat_col = cat_col or category_column(df)
    amount_col = amount_col or amount_column(df, C.AMOUNT_CANDIDATES_TRENDS)
    g = (df.select(F.col(cat_col).cast("string").alias("category"), number(amount_col).alias("x")).where("category IS NOT NULL")
         .groupBy("category").agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("total")))
    return g.orderBy(F.desc("total"), F.asc("category")).limit(n)


def run_stats(df: DataFrame, records: DataFrame) -> DataFrame:
    """AGG-12: rows processed and anomaly records detected."""
    return df.agg(F.count(F.lit(1)).alias("total_transactions")).crossJoin(
        records.agg(F.count(F.lit(1)).alias("anomalies_detected")))
