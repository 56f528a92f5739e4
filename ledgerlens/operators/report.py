"""Text reports and risk summaries (AGG-9..11, AGG-13, AGG-14).

Each report is a one-row DataFrame whose text is assembled by Spark
expressions over one-row aggregates, so it is part of the same plan as the
numbers it prints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions.columns import amount_column, category_column, first_temporal
from ..functions.exprs import fmt_fixed, fmt_grouped, number
from ..functions.quantiles import exact_quantiles
from ..session import ensure_checkpoint_dir
from .retrieval import py_float_text
from .stats import py_ts_text

# Report texts.
REPORT_HEAD = "\n📊 Financial Transaction Analysis Summary\n\nDataset Overview:\n"
RISK_HEAD = "\n🚨 Risk Assessment:\n"
ANOMALY_LINE = "\n⚠️  Anomalies Detected: %d unusual transactions\n"
BULLET = "  • "
NO_ANOMALY_TEXT = ("No anomalies detected in this batch based on the Isolation Forest model "
                   "(contamination=0.01).")


def _one_row(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("_n"))


def trend_aggregates(df: DataFrame, amt: str | None, cat: str | None, dcol: str | None) -> DataFrame:
    """One scan for every number the report prints: grouping sets over
    (), (category), (day) with count, sum, min, max and the first/last
    timestamp.  The result has one row per category and per day plus the
    total row; it is checkpointed so the report's pieces read it, not the
    table.  Columns: kind ('all' / 'cat' / 'day'), key, day, n, tv, av, mn, mx, s, e."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    key = F.col(cat).cast("string") if cat else F.lit(None).cast("string")
    day = F.to_date(dcol) if dcol else F.lit(None).cast("date")
    x = number(amt) if amt else F.lit(None).cast("double")
    base = df.select(key.alias("key"), day.alias("day"), x.alias("x"),
                     (F.col(dcol) if dcol else F.lit(None).cast("timestamp")).alias("t"))
    sets = [[]] + ([["key"]] if cat else []) + ([["day"]] if dcol else [])
    g = base.groupingSets(sets, "key", "day").agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), F.sum("x").alias("tv"),
        F.avg("x").alias("av"), F.min("x").alias("mn"), F.max("x").alias("mx"), F.min("t").alias("s"), F.max("t").alias("e"))
    kind = (F.when(F.col("gid") == 3, "all").when(F.col("gid") == 1, "cat").otherwise("day"))
    return g.select(kind.alias("kind"), "key", "day", "n", "tv", "av", "mn", "mx", "s", "e").checkpoint(eager=True)


def text_report(df: DataFrame) -> DataFrame:
    """AGG-9: the natural-language summary; absent parts omitted, absent
    numbers 0.  One pass over the table (``trend_aggregates``)."""
    amt = amount_column(df, C.AMOUNT_CANDIDATES_TRENDS)
    cat = category_column(df) if amt else None
    dcol = first_temporal(df)
    agg = trend_aggregates(df, amt, cat, dcol)
    # a global aggregate over the small table: exactly one row, even for an empty input
    is_all = F.col("kind") == "all"
    total = agg.agg(*[F.max(F.when(is_all, F.col(c))).alias(c) for c in ("n", "tv", "av", "mn", "mx", "s", "e")]) \
        .select(F.coalesce(F.col("n"), F.lit(0)).alias("n"), "tv", "av", "mn", "mx", py_ts_text(F.col("s")).alias("start"), py_ts_text(F.col("e")).alias("end"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    head = F.concat(F.lit(REPORT_HEAD),
                    F.lit("- Total Transactions: "), F.format_string("%,d", F.col("n")), F.lit("\n"),
                    F.lit("- Total Volume: $"), fmt_grouped(z("tv"), 2), F.lit("\n"),
                    F.lit("- Average Transaction: $"), fmt_fixed(z("av"), 2), F.lit("\n"),
                    F.lit("- Transaction Range: $"), fmt_fixed(z("mn"), 2), F.lit(" - $"),
                    fmt_grouped(z("mx"), 2), F.lit("\n\n"))
    parts: list[Column] = [head]
    frame = total
    if cat:
        top = (agg.where((F.col("kind") == "cat") & F.col("key").isNotNull())
               .withColumn("tv", F.coalesce("tv", F.lit(0.0))).orderBy(F.desc("tv"), F.asc("key")).limit(C.REPORT_CATEGORIES))
        lines = top.agg(F.array_sort(F.collect_list(F.struct(
            (-F.col("tv")).alias("k1"), F.col("key").alias("k2"),
            F.concat(F.lit(BULLET), F.col("key"), F.lit(": $"), fmt_grouped(F.col("tv"), 2),
                     F.lit("\n")).alias("line")))).alias("cats"))
        frame = frame.crossJoin(lines)
        parts.append(F.when(F.size("cats") > 0, F.concat(F.lit("\nTop Spending Categories:\n"),
                                                        F.array_join(F.col("cats.line"), ""))).otherwise(""))
    if dcol:
        tail = F.concat(F.lit("\nTime Period: "), F.coalesce(F.col("start"), F.lit("NaT")), F.lit(" to "),
                        F.coalesce(F.col("end"), F.lit("NaT")), F.lit("\n"))
        if amt:
            days = agg.where((F.col("kind") == "day") & F.col("day").isNotNull())
            peak_df = days.agg(F.min_by("day", F.struct((-F.col("tv")).alias("nv"), F.col("day").alias("dd")))
                               .alias("peak"), F.max("tv").alias("peak_volume")) \
                .select(F.date_format("peak", "yyyy-MM-dd").alias("peak_day"), "peak_volume")
            frame = frame.crossJoin(peak_df)
            peak = F.concat(F.lit("Peak Day: "), F.coalesce(F.col("peak_day"), F.lit("N/A")),
                            F.lit(" ($"), fmt_grouped(F.coalesce(F.col("peak_volume"), F.lit(0.0)), 2),
                            F.lit(")\n"))
        else:
            peak = F.lit("Peak Day: N/A ($0.00)\n")
        parts.append(F.concat(tail, peak))
    return frame.select(F.concat(*parts).alias("report"))


def risk_summary(df: DataFrame, prob_col: str = "fraud_probability", amount_col: str = "amount",
                 flag_col: str = "is_anomaly") -> DataFrame:
    """AGG-10: risk bands counts, mean probability, amount at risk, anomaly
    count and percentage; each part only when its column exists."""
    aggs = []
    if prob_col in df.columns:
        p = number(prob_col)
        aggs += [F.count_if(p > C.RISK_HIGH).alias("high_risk_transactions"),
                 F.count_if((p > C.RISK_LOW) & (p <= C.RISK_HIGH)).alias("medium_risk_transactions"),
                 F.count_if(p <= C.RISK_LOW).alias("low_risk_transactions"),
                 F.avg(p).alias("average_fraud_probability")]
        if amount_col in df.columns:
            aggs.append(F.coalesce(F.sum(F.when(p > C.RISK_HIGH, F.col(amount_col))), F.lit(0.0))
                        .cast("double").alias("total_amount_at_risk"))
    if flag_col in df.columns:
        a = F.col(flag_col).cast("int")
        aggs += [F.sum(a).cast("bigint").alias("total_anomalies"), (F.avg(a) * 100).alias("anomaly_percentage")]
    if not aggs:
        return _one_row(df).select(F.lit(None).cast("string").alias("empty"))
    return df.agg(*aggs)


def risk_text(summary: DataFrame) -> Column:
    cols = set(summary.columns)
    parts = [F.lit(RISK_HEAD)]
    if "high_risk_transactions" in cols:
        parts += [F.format_string(BULLET + "High Risk: %d transactions\n", F.col("high_risk_transactions")),
                  F.format_string(BULLET + "Medium Risk: %d transactions\n", F.col("medium_risk_transactions")),
                  F.format_string(BULLET + "Low Risk: %d transactions\n", F.col("low_risk_transactions"))]
    if "total_amount_at_risk" in cols:
        parts += [F.lit(BULLET + "Amount at Risk: $"), fmt_grouped(F.col("total_amount_at_risk"), 2), F.lit("\n")]
    return F.concat(*parts)


def final_summary(report: DataFrame, summary: DataFrame | None, records: DataFrame | None) -> DataFrame:
    """AGG-11: report, risk lines and anomaly line joined by newlines; missing
    parts skipped (no records -> no anomaly line)."""
    frame = report
    parts = [F.col("report")]
    if summary is not None:
        frame = frame.crossJoin(summary)
        parts.append(risk_text(summary))
    if records is not None:
        frame = frame.crossJoin(records.agg(F.count(F.lit(1)).alias("_n_records")))
        parts.append(F.when(F.col("_n_records") > 0, F.format_string(ANOMALY_LINE, F.col("_n_records"))))
    return frame.select(F.concat_ws("\n", *parts).alias("summary"))


def threshold_flags(df: DataFrame, score_col: str, contamination: float,
                    out_score: str = "anomaly_score", out_flag: str = "is_anomaly") -> DataFrame:
    """MLU-3/MLU-4 on any score: offset = exact ``contamination`` quantile of
    the scores; decision = score - offset; anomaly when decision < 0."""
    offset = exact_quantiles(df, [(score_col, contamination)])[(score_col, contamination)]
    dec = F.col(score_col) - F.lit(offset)
    return df.withColumn(out_score, dec).withColumn(out_flag, dec < 0)


def _amount_text(original: DataFrame, amount_col: str) -> Column:
    """The original amount as Python prints it; N/A for a row without one."""
    kind = original.schema[amount_col].dataType
    text = py_float_text(F.col("_orig")) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col("_orig").cast("string")
    return F.when(F.col("_orig").isNull(), "N/A").otherwise(text)


def anomaly_report(flagged: DataFrame, original: DataFrame, row_id: str = "transaction_id",
                   amount_col: str | None = None, score_col: str = "anomaly_score",
                   flag_col: str = "is_anomaly", scaled_col: str = "Scaled_Amount") -> DataFrame:
    """AGG-13: the page's anomaly report.  The three most isolated rows are a
    top-k (``TakeOrderedAndProject``); their original amount is joined back
    by row id."""
    amount_col = amount_col or amount_column(original, C.AMOUNT_CANDIDATES_PAGE)
    f = F.col(flag_col)
    stats = flagged.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(f).alias("na"),
        F.min(F.when(f, F.col(score_col))).alias("low"),
        F.avg(F.when(f, F.col(scaled_col))).alias("sa"),
        F.avg(F.when(~f, F.col(scaled_col))).alias("sn"))
    top = (flagged.where(f).select(row_id, scaled_col, score_col)
           .orderBy(score_col, row_id).limit(3)
           .join(original.select(row_id, F.col(amount_col).alias("_orig")), row_id, "left"))
    lines = top.agg(F.array_sort(F.collect_list(F.struct(
        F.col(score_col).alias("k1"), F.col(row_id).alias("k2"),
        F.concat(F.lit("- Index "), F.col(row_id).cast("string"), F.lit(f": Original '{amount_col}': "),
                 _amount_text(original, amount_col),
                 F.lit(", Scaled_Amount: "), fmt_fixed(F.col(scaled_col), 2),
                 F.lit(", Anomaly Score (Lower is worse): "), fmt_fixed(F.col(score_col), 4),
                 F.lit("\n")).alias("line")))).alias("rows"))
    text = F.concat(
        F.lit("\n    Anomaly Detection Report (Isolation Forest, Contamination=1%):\n"
              "    - Total transactions processed: "), F.col("n").cast("string"),
        F.lit("\n    - Total anomalies detected: "), F.col("na").cast("string"),
        F.lit("\n    - The lowest anomaly score (most anomalous) was: "), fmt_fixed(F.col("low"), 4),
        F.lit("\n    - The Isolation Forest model used scaled features.\n"
              "    Key observations from the detected anomalies:\n"
              "    - Average Scaled_Amount for anomalies: "), fmt_fixed(F.col("sa"), 2),
        F.lit("\n    - Average Scaled_Amount for normal transactions: "), fmt_fixed(F.col("sn"), 2),
        F.lit("\n    Sample Anomalous Transaction Details (Top 3 most isolated events):\n    "),
        F.array_join(F.col("rows.line"), ""))
    return stats.crossJoin(lines).select(
        F.when(F.col("na") == 0, F.lit(NO_ANOMALY_TEXT)).otherwise(text).alias("report"))


def alert_list(flagged: DataFrame, original: DataFrame, row_id: str = "transaction_id",
               n: int = C.ALERT_ROWS, score_col: str = "anomaly_score", flag_col: str = "is_anomaly") -> DataFrame:
    """AGG-14: flagged rows with their original columns, lowest score first,
    first n (a top-k report)."""
    s = flagged.where(F.col(flag_col)).select(row_id, score_col, flag_col)
    top = s.orderBy(score_col, row_id).limit(n)
    return original.join(top, row_id, "inner")
