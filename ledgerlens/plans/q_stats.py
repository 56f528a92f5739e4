"""Registered aggregate and report queries (AGG-1..14, MLU-3 on a fixed score)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import measured, r6
from ..operators import anomaly as A
from ..operators import report as R
from ..operators import stats as S
from ..operators.features import scaled_amount
from ..sources.views import SQL_SCORED, SQL_TXN, SQL_TXN_DAMAGED, scored, txn, txn_damaged
from .catalog import register
from .q_anomaly import _f_sql, _z_sql

SQL_RECORDS = f"""{_z_sql('txn')}, {_f_sql('txn')},
records AS (SELECT row_id FROM z WHERE z > 3 UNION ALL SELECT NULL FROM unusual)"""


@register("dataset_stats", f"""WITH {SQL_TXN}, {SQL_RECORDS}
SELECT (SELECT count(*) FROM txn) AS total_transactions, (SELECT count(*) FROM records) AS total_anomalies,
       coalesce((SELECT count(*) FROM records) / nullif((SELECT count(*) FROM txn), 0), 0.0) AS anomaly_rate,
       'transaction_id,customer_id,amount,category,transaction_date,is_fraud' AS columns""")
def q_dataset_stats(spark, sf_dir):
    t = txn(spark, sf_dir)
    return S.dataset_stats(t, A.anomaly_records(t))


def _describe_sql(cte: str = SQL_TXN, table: str = "txn") -> str:
    parts = []
    for c in ["transaction_id", "customer_id", "amount", "is_fraud", "transaction_date"]:
        if c == "transaction_date":
            # timestamps: epoch seconds to the millisecond (15+ significant digits
            # are past what both engines' rounding reproduces)
            parts += [f"SELECT '{c}' AS column, '{st}' AS stat, round(cast({e} AS double) / 1e6, 3) AS value FROM {table}"
                      if st != "count" else
                      f"SELECT '{c}' AS column, '{st}' AS stat, cast({e} AS double) AS value FROM {table}"
                      for st, e in [("count", f"count({c})"), ("mean", f"avg(epoch_us({c}))"),
                                    ("std", "max(NULL)"), ("min", f"min(epoch_us({c}))"),
                                    ("25%", f"quantile_cont(epoch_us({c}), 0.25)"),
                                    ("50%", f"quantile_cont(epoch_us({c}), 0.5)"),
                                    ("75%", f"quantile_cont(epoch_us({c}), 0.75)"),
                                    ("max", f"max(epoch_us({c}))")]]
            continue
        for stat, e in [("count", f"count({c})"), ("mean", f"avg({c})"), ("std", f"stddev_samp({c})"),
                        ("min", f"min({c})"), ("25%", f"quantile_cont({c}, 0.25)"),
                        ("50%", f"quantile_cont({c}, 0.5)"), ("75%", f"quantile_cont({c}, 0.75)"),
                        ("max", f"max({c})")]:
            parts.append(f"SELECT '{c}' AS column, '{stat}' AS stat, round(cast({e} AS double), 6) AS value FROM {table}")
    return f"WITH {cte}\n" + "\nUNION ALL\n".join(parts)


def _described(df):
    ts_row = (F.col("column") == "transaction_date") & (F.col("stat") != "count")
    return S.describe_numeric(df).withColumn("value", F.when(ts_row, F.round("value", 3)).otherwise(r6(F.col("value"))))


@register("describe_numeric", _describe_sql())
def q_describe_numeric(spark, sf_dir):
    return _described(txn(spark, sf_dir))


@register("describe_numeric_dirty", _describe_sql(SQL_TXN_DAMAGED, "txn_damaged"))
def q_describe_numeric_dirty(spark, sf_dir):
    return _described(txn_damaged(spark, sf_dir))


@register("describe_sketch_check", f"""WITH {SQL_TXN_DAMAGED}
SELECT c AS column, q AS stat, n, true AS within_error FROM (SELECT unnest(['25%', '50%', '75%']) AS q),
  (SELECT 'amount' AS c, count(amount) AS n FROM txn_damaged UNION ALL SELECT 'customer_id', count(customer_id) FROM txn_damaged)""")
def q_describe_sketch_check(spark, sf_dir):
    """Quartiles of one pass: the ranks of the values are counted, none is farther off than the stated error."""
    t = txn_damaged(spark, sf_dir).select("amount", "customer_id")
    d = S.describe_numeric(t, ["amount", "customer_id"], timestamps=False, rank_error=0.005).where("stat like '%\\%'")
    kinds = F.inline(F.array(*(F.struct(F.lit(c).alias("column"), measured(t, c).cast("double").alias("x")) for c in ("amount", "customer_id"))))
    ranks = t.select(kinds).where("x IS NOT NULL").join(F.broadcast(d), "column").groupBy("column", "stat").agg(      # six rows
        F.count("*").alias("n"), F.count_if(F.col("x") < F.col("value")).alias("below"), F.count_if(F.col("x") <= F.col("value")).alias("upto"))
    wanted = F.regexp_replace("stat", "%", "").cast("double") / 100 * F.col("n")
    return ranks.select("column", "stat", "n", ((F.col("below") - wanted <= 0.005 * F.col("n")) & (wanted - F.col("upto") <= 0.005 * F.col("n"))).alias("within_error"))


@register("fraud_stats", f"""WITH {SQL_TXN}
SELECT cast(sum(is_fraud) AS bigint) AS fraud_count, round(avg(is_fraud), 6) AS fraud_rate FROM txn""")
def q_fraud_stats(spark, sf_dir):
    return S.fraud_stats(txn(spark, sf_dir)).withColumn("fraud_rate", r6(F.col("fraud_rate")))


@register("run_stats", f"""WITH {SQL_TXN}, {SQL_RECORDS}
SELECT (SELECT count(*) FROM txn) AS total_transactions, (SELECT count(*) FROM records) AS anomalies_detected""")
def q_run_stats(spark, sf_dir):
    t = txn(spark, sf_dir)
    return S.run_stats(t, A.anomaly_records(t))


SQL_PROFILE = """SELECT round(sum(amount), 6) AS total_volume, round(avg(amount), 6) AS average_transaction,
       round(quantile_cont(amount, 0.5), 6) AS median_transaction, round(max(amount), 6) AS max_transaction,
       round(min(amount), 6) AS min_transaction FROM """


def _profiled(df):
    p = S.amount_profile(df)
    return p.select(*[r6(F.col(c)).alias(c) for c in p.columns])


@register("amount_profile", f"WITH {SQL_TXN}\n{SQL_PROFILE} txn")
def q_amount_profile(spark, sf_dir):
    return _profiled(txn(spark, sf_dir))


@register("amount_profile_dirty", f"WITH {SQL_TXN_DAMAGED}\n{SQL_PROFILE} txn_damaged")
def q_amount_profile_dirty(spark, sf_dir):
    return _profiled(txn_damaged(spark, sf_dir))


PY_TS = ("CASE WHEN epoch_us({c}) % 1000000 = 0 THEN strftime({c}, '%Y-%m-%d %H:%M:%S') "
         "ELSE strftime({c}, '%Y-%m-%d %H:%M:%S.%f') END")


@register("date_range", f"""WITH {SQL_TXN}
SELECT {PY_TS.format(c='min(transaction_date)')} AS start, {PY_TS.format(c='max(transaction_date)')} AS "end" FROM txn""")
def q_date_range(spark, sf_dir):
    return S.date_range(txn(spark, sf_dir))


SQL_DAILY = "daily AS (SELECT cast(transaction_date AS date) AS day, sum(amount) AS volume FROM txn GROUP BY 1)"


@register("daily_volume", f"""WITH {SQL_TXN}, {SQL_DAILY}
SELECT strftime(day, '%Y-%m-%d') AS day, round(volume, 6) AS volume FROM daily""")
def q_daily_volume(spark, sf_dir):
    d = S.daily_volume(txn(spark, sf_dir))
    return d.select(F.date_format("day", "yyyy-MM-dd").alias("day"), r6(F.col("volume")).alias("volume"))


@register("daily_peak", f"""WITH {SQL_TXN}, {SQL_DAILY}
SELECT round(avg(volume), 6) AS daily_average,
       (SELECT strftime(day, '%Y-%m-%d') FROM daily ORDER BY volume DESC, day LIMIT 1) AS peak_day,
       round(max(volume), 6) AS peak_volume FROM daily""")
def q_daily_peak(spark, sf_dir):
    d = S.daily_peak(txn(spark, sf_dir))
    return d.select(r6(F.col("daily_average")).alias("daily_average"), "peak_day",
                    r6(F.col("peak_volume")).alias("peak_volume"))


@register("top_categories", f"""WITH {SQL_TXN}
SELECT category, round(sum(amount), 6) AS total FROM txn GROUP BY category ORDER BY sum(amount) DESC, category LIMIT 5""")
def q_top_categories(spark, sf_dir):
    return S.top_categories(txn(spark, sf_dir)).withColumn("total", r6(F.col("total")))


# the same operators on missing amounts, categories and dates
@register("daily_peak_dirty", f"""WITH {SQL_TXN_DAMAGED},
daily AS (SELECT cast(transaction_date AS date) AS day, coalesce(sum(amount), 0) AS volume FROM txn_damaged
          WHERE transaction_date IS NOT NULL GROUP BY 1)
SELECT round(avg(volume), 6) AS daily_average,
       (SELECT strftime(day, '%Y-%m-%d') FROM daily ORDER BY volume DESC, day LIMIT 1) AS peak_day,
       round(max(volume), 6) AS peak_volume FROM daily""")
def q_daily_peak_dirty(spark, sf_dir):
    d = S.daily_peak(txn_damaged(spark, sf_dir))
    return d.select(r6(F.col("daily_average")).alias("daily_average"), "peak_day",
                    r6(F.col("peak_volume")).alias("peak_volume"))


@register("top_categories_dirty", f"""WITH {SQL_TXN_DAMAGED}
SELECT category, round(coalesce(sum(amount), 0), 6) AS total FROM txn_damaged WHERE category IS NOT NULL
GROUP BY category ORDER BY sum(amount) DESC, category LIMIT 5""")
def q_top_categories_dirty(spark, sf_dir):
    return S.top_categories(txn_damaged(spark, sf_dir)).withColumn("total", r6(F.col("total")))


SQL_REPORT_BODY = """agg AS (SELECT count(*) AS n, sum(amount) AS tv, avg(amount) AS av, min(amount) AS mn,
                   max(amount) AS mx, min(transaction_date) AS s, max(transaction_date) AS e FROM {src}),
cats AS (SELECT category, sum(amount) AS total FROM {src} WHERE category IS NOT NULL GROUP BY category ORDER BY total DESC, category LIMIT 3),
catlines AS (SELECT string_agg('  • ' || category || ': $' || format('{{:,.2f}}', total) || chr(10), ''
                               ORDER BY total DESC, category) AS lines FROM cats),
dly AS (SELECT cast(transaction_date AS date) AS day, sum(amount) AS volume FROM {src} WHERE transaction_date IS NOT NULL GROUP BY 1),
peak AS (SELECT strftime(day, '%Y-%m-%d') AS peak_day, volume AS peak_volume FROM dly ORDER BY volume DESC, day LIMIT 1),
report AS (
  SELECT chr(10) || '📊 Financial Transaction Analysis Summary' || chr(10) || chr(10) || 'Dataset Overview:' || chr(10)
      || '- Total Transactions: ' || format('{{:,}}', n) || chr(10)
      || '- Total Volume: $' || format('{{:,.2f}}', coalesce(tv, 0.0)) || chr(10)
      || '- Average Transaction: $' || printf('%.2f', coalesce(av, 0.0)) || chr(10)
      || '- Transaction Range: $' || printf('%.2f', coalesce(mn, 0.0)) || ' - $' || format('{{:,.2f}}', coalesce(mx, 0.0))
      || chr(10) || chr(10)
      || CASE WHEN lines IS NULL THEN '' ELSE chr(10) || 'Top Spending Categories:' || chr(10) || lines END
      || chr(10) || 'Time Period: ' || {ps} || ' to ' || {pe} || chr(10)
      || 'Peak Day: ' || coalesce(peak_day, 'N/A') || ' ($' || format('{{:,.2f}}', coalesce(peak_volume, 0.0)) || ')' || chr(10)
      AS report
  FROM agg, catlines LEFT JOIN peak ON true)"""


def _report_sql(src: str) -> str:
    return SQL_REPORT_BODY.format(src=src, ps=PY_TS.format(c="s"), pe=PY_TS.format(c="e"))


@register("text_report", f"WITH {SQL_TXN}, {_report_sql('txn')}\nSELECT report FROM report")
def q_text_report(spark, sf_dir):
    return R.text_report(txn(spark, sf_dir))


@register("text_report_dirty", f"WITH {SQL_TXN_DAMAGED}, {_report_sql('txn_damaged')}\nSELECT report FROM report")
def q_text_report_dirty(spark, sf_dir):
    return R.text_report(txn_damaged(spark, sf_dir))


SQL_RISK = """risk AS (SELECT count(*) FILTER (WHERE fraud_probability > 0.7) AS high_risk_transactions,
       count(*) FILTER (WHERE fraud_probability > 0.3 AND fraud_probability <= 0.7) AS medium_risk_transactions,
       count(*) FILTER (WHERE fraud_probability <= 0.3) AS low_risk_transactions,
       avg(fraud_probability) AS average_fraud_probability,
       coalesce(sum(amount) FILTER (WHERE fraud_probability > 0.7), 0.0) AS total_amount_at_risk
FROM scored)"""


@register("risk_summary", f"""WITH {SQL_SCORED}, {SQL_RISK}
SELECT high_risk_transactions, medium_risk_transactions, low_risk_transactions,
       round(average_fraud_probability, 6) AS average_fraud_probability,
       round(total_amount_at_risk, 6) AS total_amount_at_risk FROM risk""")
def q_risk_summary(spark, sf_dir):
    r = R.risk_summary(scored(spark, sf_dir))
    return r.select("high_risk_transactions", "medium_risk_transactions", "low_risk_transactions",
                    r6(F.col("average_fraud_probability")).alias("average_fraud_probability"),
                    r6(F.col("total_amount_at_risk")).alias("total_amount_at_risk"))


SQL_PAGE = """off AS (SELECT quantile_cont(anomaly_raw, 0.01) AS o FROM scored),
sst AS (SELECT avg(amount) AS m, stddev_pop(amount) AS sd FROM scored),
page AS (SELECT scored.*, anomaly_raw - o AS anomaly_score, anomaly_raw - o < 0 AS is_anomaly,
                (amount - m) / coalesce(nullif(sd, 0), 1) AS Scaled_Amount FROM scored, off, sst)"""


def page_frame(spark, sf_dir):
    s = scaled_amount(scored(spark, sf_dir), "amount")
    return R.threshold_flags(s, "anomaly_raw", 0.01)


@register("risk_summary_unsupervised", f"""WITH {SQL_SCORED}, {SQL_PAGE}
SELECT cast(sum(cast(is_anomaly AS integer)) AS bigint) AS total_anomalies,
       round(avg(cast(is_anomaly AS integer)) * 100, 6) AS anomaly_percentage FROM page""")
def q_risk_summary_unsupervised(spark, sf_dir):
    r = R.risk_summary(page_frame(spark, sf_dir).drop("fraud_probability"))
    return r.select("total_anomalies", r6(F.col("anomaly_percentage")).alias("anomaly_percentage"))


SQL_RISK_TEXT = """chr(10) || '🚨 Risk Assessment:' || chr(10)
 || '  • High Risk: ' || high_risk_transactions || ' transactions' || chr(10)
 || '  • Medium Risk: ' || medium_risk_transactions || ' transactions' || chr(10)
 || '  • Low Risk: ' || low_risk_transactions || ' transactions' || chr(10)
 || '  • Amount at Risk: $' || format('{:,.2f}', total_amount_at_risk) || chr(10)"""


@register("final_summary", f"""WITH {SQL_SCORED}, {_report_sql('scored')}, {SQL_RISK}, {SQL_RECORDS}
SELECT report || chr(10) || {SQL_RISK_TEXT}
       || CASE WHEN (SELECT count(*) FROM records) > 0
               THEN chr(10) || chr(10) || '⚠️  Anomalies Detected: ' || (SELECT count(*) FROM records)
                    || ' unusual transactions' || chr(10) ELSE '' END AS summary
FROM report, risk""")
def q_final_summary(spark, sf_dir):
    s = scored(spark, sf_dir)
    return R.final_summary(R.text_report(s), R.risk_summary(s), A.anomaly_records(txn(spark, sf_dir)))


@register("anomaly_threshold", f"""WITH {SQL_SCORED}, {SQL_PAGE}
SELECT transaction_id, round(anomaly_score, 6) AS anomaly_score, is_anomaly FROM page""")
def q_anomaly_threshold(spark, sf_dir):
    return page_frame(spark, sf_dir).select("transaction_id", r6(F.col("anomaly_score")).alias("anomaly_score"),
                                            "is_anomaly")


ORACLE_ANOMALY_REPORT = f"""WITH {SQL_SCORED}, {SQL_PAGE},
st AS (SELECT count(*) AS n, count(*) FILTER (WHERE is_anomaly) AS na,
              min(anomaly_score) FILTER (WHERE is_anomaly) AS low,
              avg(Scaled_Amount) FILTER (WHERE is_anomaly) AS sa,
              avg(Scaled_Amount) FILTER (WHERE NOT is_anomaly) AS sn FROM page),
top3 AS (SELECT * FROM page WHERE is_anomaly ORDER BY anomaly_score, transaction_id LIMIT 3),
lines AS (SELECT string_agg('- Index ' || transaction_id || ': Original ''amount'': ' || cast(amount AS varchar)
                 || ', Scaled_Amount: ' || printf('%.2f', Scaled_Amount)
                 || ', Anomaly Score (Lower is worse): ' || printf('%.4f', anomaly_score) || chr(10), ''
                 ORDER BY anomaly_score, transaction_id) AS rows FROM top3)
SELECT CASE WHEN na = 0 THEN 'No anomalies detected in this batch based on the Isolation Forest model (contamination=0.01).'
  ELSE chr(10) || '    Anomaly Detection Report (Isolation Forest, Contamination=1%):' || chr(10)
    || '    - Total transactions processed: ' || n || chr(10)
    || '    - Total anomalies detected: ' || na || chr(10)
    || '    - The lowest anomaly score (most anomalous) was: ' || printf('%.4f', low) || chr(10)
    || '    - The Isolation Forest model used scaled features.' || chr(10)
    || '    Key observations from the detected anomalies:' || chr(10)
    || '    - Average Scaled_Amount for anomalies: ' || printf('%.2f', sa) || chr(10)
    || '    - Average Scaled_Amount for normal transactions: ' || printf('%.2f', sn) || chr(10)
    || '    Sample Anomalous Transaction Details (Top 3 most isolated events):' || chr(10) || '    '
    || coalesce(rows, '') END AS report
FROM st, lines"""


@register("anomaly_report", ORACLE_ANOMALY_REPORT)
def q_anomaly_report(spark, sf_dir):
    return R.anomaly_report(page_frame(spark, sf_dir), txn(spark, sf_dir))


@register("alert_list", f"""WITH {SQL_SCORED}, {SQL_PAGE}
SELECT transaction_id, customer_id, round(amount, 6) AS amount, category,
       strftime(transaction_date, '%Y-%m-%d %H:%M:%S') AS transaction_date, is_fraud,
       round(anomaly_score, 6) AS anomaly_score, is_anomaly
FROM page WHERE is_anomaly ORDER BY anomaly_score, transaction_id LIMIT 10""")
def q_alert_list(spark, sf_dir):
    a = R.alert_list(page_frame(spark, sf_dir), txn(spark, sf_dir))
    return a.select("transaction_id", "customer_id", r6(F.col("amount")).alias("amount"), "category",
                    F.date_format("transaction_date", "yyyy-MM-dd HH:mm:ss").alias("transaction_date"),
                    "is_fraud", r6(F.col("anomaly_score")).alias("anomaly_score"), "is_anomaly")
