"""Registered anomaly queries (ANO-1..5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly as A
from ..sources.views import SQL_TXN, SQL_TXN_DAMAGED, SQL_TXN_ORDERS, txn, txn_damaged, txn_orders
from .catalog import register

SQL_Z_CORE = """zs AS (SELECT avg(amount) AS m, stddev_samp(amount) AS sd FROM {src}),
z AS (SELECT transaction_id AS row_id, amount, abs((amount - m) / nullif(sd, 0)) AS z FROM {src}, zs)"""

SQL_FREQ_CORE = """cnt AS (SELECT customer_id, count(*) AS n_rows FROM {src}
                    WHERE customer_id IS NOT NULL GROUP BY customer_id),
cs AS (SELECT avg(n_rows) AS m, stddev_samp(n_rows) AS sd FROM cnt),
unusual AS (SELECT customer_id, n_rows, m FROM cnt, cs WHERE n_rows > m + 3 * sd)"""


def _z_sql(src: str) -> str:
    return SQL_Z_CORE.format(src=src)


def _f_sql(src: str) -> str:
    return SQL_FREQ_CORE.format(src=src)


Z_RECORDS = """SELECT 'statistical_outlier' AS type,
       CASE WHEN z > 4 THEN 'high' ELSE 'medium' END AS severity,
       printf('Amount %.2f is %.2f standard deviations from mean', amount, z) AS reason,
       row_id, round(amount, 6) AS amount, round(z, 6) AS z_score
FROM z WHERE z > 3"""


@register("anomaly_zscore", f"WITH {SQL_TXN}, {_z_sql('txn')}\n{Z_RECORDS}")
def q_anomaly_zscore(spark, sf_dir):
    r = A.zscore_outliers(txn(spark, sf_dir))
    return r.select("type", "severity", "reason", "row_id", F.round("amount", 6).alias("amount"),
                    F.round("z_score", 6).alias("z_score"))


@register("anomaly_zscore_dirty", f"WITH {SQL_TXN_DAMAGED}, {_z_sql('txn_damaged')}\n{Z_RECORDS}")
def q_anomaly_zscore_dirty(spark, sf_dir):
    r = A.zscore_outliers(txn_damaged(spark, sf_dir))
    return r.select("type", "severity", "reason", "row_id", F.round("amount", 6).alias("amount"),
                    F.round("z_score", 6).alias("z_score"))


F_RECORDS = """SELECT 'high_frequency' AS type, 'medium' AS severity,
       printf('Customer %s has %d transactions (mean: %.1f)', cast(customer_id AS varchar), n_rows, m) AS reason,
       cast(customer_id AS varchar) AS subject, n_rows
FROM unusual"""


@register("anomaly_frequency", f"WITH {SQL_TXN_ORDERS}, {_f_sql('txn_orders')}\n{F_RECORDS}")
def q_anomaly_frequency(spark, sf_dir):
    r = A.frequency_outliers(txn_orders(spark, sf_dir))
    return r.select("type", "severity", "reason", "subject", "n_rows")


@register("anomaly_frequency_rows", f"""WITH {SQL_TXN_ORDERS}, {_f_sql('txn_orders')}
SELECT t.transaction_id AS row_id, cast(t.customer_id AS varchar) AS subject
FROM txn_orders t SEMI JOIN unusual u ON t.customer_id = u.customer_id""")
def q_anomaly_frequency_rows(spark, sf_dir):
    return A.frequency_rows(txn_orders(spark, sf_dir))


UNION_SQL = """SELECT type, severity, reason, NULL::varchar AS subject, row_id, 1::bigint AS n_rows FROM z WHERE z > 3
UNION ALL
SELECT 'high_frequency', 'medium',
       printf('Customer %s has %d transactions (mean: %.1f)', cast(customer_id AS varchar), n_rows, m),
       cast(customer_id AS varchar), NULL::bigint, n_rows FROM unusual"""


def _union_sql(src_cte: str, src: str) -> str:
    zrec = ("zr AS (SELECT 'statistical_outlier' AS type, CASE WHEN z > 4 THEN 'high' ELSE 'medium' END AS severity, "
            "printf('Amount %.2f is %.2f standard deviations from mean', amount, z) AS reason, row_id, z FROM z)")
    return (f"WITH {src_cte}, {_z_sql(src)}, {_f_sql(src)}, {zrec}\n"
            + UNION_SQL.replace("FROM z WHERE z > 3", "FROM zr WHERE z > 3"))


@register("anomaly_union", _union_sql(SQL_TXN, "txn"))
def q_anomaly_union(spark, sf_dir):
    return A.anomaly_records(txn(spark, sf_dir))


@register("anomaly_union_orders", _union_sql(SQL_TXN_ORDERS, "txn_orders"))
def q_anomaly_union_orders(spark, sf_dir):
    return A.anomaly_records(txn_orders(spark, sf_dir))


@register("anomaly_flag", f"""WITH {SQL_TXN_ORDERS}, {_z_sql('txn_orders')}, {_f_sql('txn_orders')}
SELECT t.transaction_id, t.customer_id, round(t.amount, 6) AS amount, t.category,
       strftime(t.transaction_date, '%Y-%m-%d %H:%M:%S') AS transaction_date,
       coalesce(z.z > 3, false) OR (u.customer_id IS NOT NULL) AS is_anomaly
FROM txn_orders t JOIN z ON z.row_id = t.transaction_id
LEFT JOIN unusual u ON u.customer_id = t.customer_id""")
def q_anomaly_flag(spark, sf_dir):
    f = A.flag_anomalies(txn_orders(spark, sf_dir))
    return f.select("transaction_id", "customer_id", F.round("amount", 6).alias("amount"), "category",
                    F.date_format("transaction_date", "yyyy-MM-dd HH:mm:ss").alias("transaction_date"),
                    "is_anomaly")


@register("anomaly_flag_txn", f"""WITH {SQL_TXN}, {_z_sql('txn')}, {_f_sql('txn')}
SELECT t.transaction_id, coalesce(z.z > 3, false) OR (u.customer_id IS NOT NULL) AS is_anomaly
FROM txn t JOIN z ON z.row_id = t.transaction_id
LEFT JOIN unusual u ON u.customer_id = t.customer_id""")
def q_anomaly_flag_txn(spark, sf_dir):
    return A.flag_anomalies(txn(spark, sf_dir)).select("transaction_id", "is_anomaly")


def _count_sql(src_cte: str, src: str) -> str:
    full = _union_sql(src_cte, src)
    head, _, body = full.partition("\nSELECT type, severity")
    return head + "\nSELECT count(*) AS count FROM (SELECT type, severity" + body + ")"


@register("anomaly_count", _count_sql(SQL_TXN, "txn"))
def q_anomaly_count(spark, sf_dir):
    return A.anomaly_count(A.anomaly_records(txn(spark, sf_dir)))
