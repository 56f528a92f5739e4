"""Registered projection and feature queries (PRJ-12..14, FEA-1..7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as P
from ..functions.exprs import fmt_fixed, fmt_grouped
from ..operators import features as FE
from .. import config as C
from ..functions import columns as P
from ..functions.exprs import measured
from ..sources.views import SQL_TXN, SQL_TXN_DAMAGED, SQL_TXN_DIRTY, SQL_TXN_ORDERS, txn, txn_damaged, txn_dirty, txn_orders
from .catalog import register


@register("numeric_projection", f"""WITH {SQL_TXN}
SELECT transaction_id, customer_id, round(amount, 6) AS amount, is_fraud FROM txn""")
def q_numeric_projection(spark, sf_dir):
    d = P.select_numeric(txn(spark, sf_dir))
    return d.withColumn("amount", F.round("amount", 6))


@register("drop_columns", f"""WITH {SQL_TXN}
SELECT transaction_id, customer_id, category FROM txn""")
def q_drop_columns(spark, sf_dir):
    return FE.drop_columns(txn(spark, sf_dir), ["is_fraud", "transaction_date", "amount", "Time"])


@register("align_features", f"""WITH {SQL_TXN}
SELECT transaction_id, round(amount, 6) AS amount, customer_id, 0 AS hour, 0 AS merchant_code FROM txn""")
def q_align_features(spark, sf_dir):
    d = FE.align_features(txn(spark, sf_dir), ["amount", "customer_id", "hour", "merchant_code"],
                          keep=["transaction_id"])
    return d.withColumn("amount", F.round("amount", 6))


@register("calendar_features", f"""WITH {SQL_TXN}
SELECT transaction_id, cast(hour(transaction_date) AS integer) AS hour,
       cast(isodow(transaction_date) - 1 AS integer) AS day_of_week,
       cast(isodow(transaction_date) IN (6, 7) AS integer) AS is_weekend,
       cast(month(transaction_date) AS integer) AS month
FROM txn""")
def q_calendar_features(spark, sf_dir):
    d = FE.calendar_features(txn(spark, sf_dir))
    return d.select("transaction_id", "hour", "day_of_week", "is_weekend", "month")


@register("calendar_features_dirty", f"""WITH {SQL_TXN_DAMAGED}
SELECT transaction_id, coalesce(cast(hour(transaction_date) AS integer), -1) AS hour,
       coalesce(cast(isodow(transaction_date) - 1 AS integer), -1) AS day_of_week,
       coalesce(cast(isodow(transaction_date) IN (6, 7) AS integer), 0) AS is_weekend,
       coalesce(cast(month(transaction_date) AS integer), -1) AS month
FROM txn_damaged""")
def q_calendar_features_dirty(spark, sf_dir):
    d = FE.calendar_features(txn_damaged(spark, sf_dir))
    or_none = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("hour", "day_of_week", "month")]   # null stays visible as -1
    return d.select("transaction_id", *or_none, "is_weekend")


@register("one_hot", f"""WITH {SQL_TXN}
SELECT transaction_id, category,
       coalesce(category = 'error', false) AS category_error,
       coalesce(category = 'purchase', false) AS category_purchase,
       coalesce(category = 'signup', false) AS category_signup,
       coalesce(category = 'view', false) AS category_view
FROM txn""")
def q_one_hot(spark, sf_dir):
    d = FE.one_hot(txn(spark, sf_dir))
    return d.drop("customer_id", "amount", "transaction_date", "is_fraud")


@register("one_hot_dirty", f"""WITH {SQL_TXN_DIRTY}
SELECT transaction_id, category, transaction_date,
       coalesce(category = 'error', false) AS category_error,
       coalesce(category = 'purchase', false) AS category_purchase,
       coalesce(category = 'signup', false) AS category_signup,
       coalesce(category = 'view', false) AS category_view
FROM txn_dirty""")
def q_one_hot_dirty(spark, sf_dir):
    # transaction_date is text with ~10k distinct values: above the 50-value gate, so not encoded
    d = FE.one_hot(txn_dirty(spark, sf_dir))
    return d.drop("customer_id", "amount", "is_fraud")


@register("timestamp_expand", f"""WITH {SQL_TXN}
SELECT transaction_id, cast(hour(transaction_date) AS integer) AS transaction_date_hour,
       cast(day(transaction_date) AS integer) AS transaction_date_day,
       cast(month(transaction_date) AS integer) AS transaction_date_month,
       cast(isodow(transaction_date) - 1 AS integer) AS transaction_date_dayofweek
FROM txn""")
def q_timestamp_expand(spark, sf_dir):
    d = FE.timestamp_expand(txn(spark, sf_dir))
    return d.drop("customer_id", "amount", "category", "is_fraud")


SQL_CODES = """codes AS (SELECT category AS value, dense_rank() OVER (ORDER BY category) - 1 AS code
                        FROM (SELECT DISTINCT coalesce(category, 'nan') AS category FROM txn))"""


@register("label_encode", f"""WITH {SQL_TXN}, {SQL_CODES}
SELECT transaction_id, code AS category FROM txn JOIN codes ON coalesce(txn.category, 'nan') = codes.value""")
def q_label_encode(spark, sf_dir):
    t = txn(spark, sf_dir)
    enc = FE.fit_label_encoders(t, ["category"])
    return FE.apply_label_encoders(t, enc).select("transaction_id", "category")


@register("label_encode_unseen", f"""WITH {SQL_TXN_DIRTY}, {SQL_CODES}
SELECT transaction_id, coalesce(code, -1) AS category
FROM txn_dirty LEFT JOIN codes ON coalesce(txn_dirty.category, 'nan') = codes.value""")
def q_label_encode_unseen(spark, sf_dir):
    enc = FE.fit_label_encoders(txn(spark, sf_dir), ["category"])
    return FE.apply_label_encoders(txn_dirty(spark, sf_dir), enc).select("transaction_id", "category")


@register("standard_scale", f"""WITH {SQL_TXN},
s AS (SELECT avg(transaction_id) AS m1, stddev_pop(transaction_id) AS s1, avg(customer_id) AS m2,
             stddev_pop(customer_id) AS s2, avg(amount) AS m3, stddev_pop(amount) AS s3,
             avg(is_fraud) AS m4, stddev_pop(is_fraud) AS s4 FROM txn)
SELECT transaction_id AS row_id,
       round((transaction_id - m1) / coalesce(nullif(s1, 0), 1), 6) AS transaction_id,
       round((customer_id - m2) / coalesce(nullif(s2, 0), 1), 6) AS customer_id,
       round((amount - m3) / coalesce(nullif(s3, 0), 1), 6) AS amount,
       round((is_fraud - m4) / coalesce(nullif(s4, 0), 1), 6) AS is_fraud
FROM txn, s""")
def q_standard_scale(spark, sf_dir):
    t = txn(spark, sf_dir).withColumn("row_id", F.col("transaction_id"))
    d = FE.standard_scale(t, ["transaction_id", "customer_id", "amount", "is_fraud"])
    return d.select("row_id", *[F.round(c, 6).alias(c) for c in
                                ["transaction_id", "customer_id", "amount", "is_fraud"]])


@register("standard_scale_dirty", f"""WITH {SQL_TXN_DAMAGED},
s AS (SELECT avg(amount) AS m, stddev_pop(amount) AS sd, avg(is_fraud) AS m4, stddev_pop(is_fraud) AS s4 FROM txn_damaged)
SELECT transaction_id, round((amount - m) / coalesce(nullif(sd, 0), 1), 6) AS amount,
       round((is_fraud - m4) / coalesce(nullif(s4, 0), 1), 6) AS is_fraud FROM txn_damaged, s""")
def q_standard_scale_dirty(spark, sf_dir):
    d = FE.standard_scale(txn_damaged(spark, sf_dir), ["amount", "is_fraud"])
    return d.select("transaction_id", F.round("amount", 6).alias("amount"), F.round("is_fraud", 6).alias("is_fraud"))


@register("scaled_amount_dirty", f"""WITH {SQL_TXN_DAMAGED}, s AS (SELECT avg(amount) AS m, stddev_pop(amount) AS sd FROM txn_damaged)
SELECT transaction_id, round((amount - m) / coalesce(nullif(sd, 0), 1), 6) AS Scaled_Amount FROM txn_damaged, s""")
def q_scaled_amount_dirty(spark, sf_dir):
    d = FE.scaled_amount(txn_damaged(spark, sf_dir), "amount")
    return d.select("transaction_id", F.round("Scaled_Amount", 6).alias("Scaled_Amount"))


@register("scaled_amount", f"""WITH {SQL_TXN}, s AS (SELECT avg(amount) AS m, stddev_pop(amount) AS sd FROM txn)
SELECT transaction_id, round((amount - m) / coalesce(nullif(sd, 0), 1), 6) AS Scaled_Amount FROM txn, s""")
def q_scaled_amount(spark, sf_dir):
    d = FE.scaled_amount(txn(spark, sf_dir), "amount")
    return d.select("transaction_id", F.round("Scaled_Amount", 6).alias("Scaled_Amount"))


@register("anomaly_messages", f"""WITH {SQL_TXN},
g AS (SELECT category, sum(amount) AS total, avg(amount) AS mean, min(amount) AS low,
             avg(abs(amount - 50.0)) AS spread FROM txn GROUP BY category)
SELECT category, '$' || format('{{:,.2f}}', total) AS total_text, printf('%.1f', mean) AS mean_text,
       printf('%.4f', low) AS low_text, printf('%.2f', spread) AS spread_text FROM g""")
def q_anomaly_messages(spark, sf_dir):
    g = txn(spark, sf_dir).groupBy("category").agg(
        F.sum("amount").alias("total"), F.avg("amount").alias("mean"), F.min("amount").alias("low"),
        F.avg(F.abs(F.col("amount") - 50.0)).alias("spread"))
    return g.select("category", F.concat(F.lit("$"), fmt_grouped(F.col("total"), 2)).alias("total_text"),
                    fmt_fixed(F.col("mean"), 1).alias("mean_text"), fmt_fixed(F.col("low"), 4).alias("low_text"),
                    fmt_fixed(F.col("spread"), 2).alias("spread_text"))


# --- PRJ-1..11: columns by name and type ------------------------------------

#: Rule, resolver, and what it finds in the two tables.
_RULES = [
    ("amount, anomaly", lambda d: P.amount_column(d, C.AMOUNT_CANDIDATES_ANOMALY), "amount", "amount"),
    ("amount, trends", lambda d: P.amount_column(d, C.AMOUNT_CANDIDATES_TRENDS), "amount", "amount"),
    ("amount, page", lambda d: P.amount_column(d, C.AMOUNT_CANDIDATES_PAGE, required=True), "amount", "amount"),
    ("customer", P.customer_column, "customer_id", "customer_id"),
    ("dates by name", lambda d: ",".join(P.date_columns_by_name(d)), "transaction_date", "transaction_date"),
    ("first date", P.first_temporal, "transaction_date", "transaction_date"),
    ("time, page", P.time_column_page, None, None),
    ("label", P.label_column, "is_fraud", None),
    ("label, training", P.training_label_column, "is_fraud", None),
    ("label, statistics", P.stats_label_column, "is_fraud", None),
    ("category", P.category_column, "category", "category"),
]


def _rules_sql() -> str:
    rows = [(t, rule, found) for rule, _, a, b in _RULES for t, found in (("txn_damaged", a), ("txn_orders", b))]
    return f"WITH {SQL_TXN_DAMAGED}, {SQL_TXN_ORDERS}\n" + "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, '{rule}' AS rule, {'NULL' if c is None else repr(c)} AS column_name, count({'NULL' if c is None else c}) AS n_values FROM {t}" for t, rule, c in rows)


@register("resolved_columns", _rules_sql())
def q_resolved_columns(spark, sf_dir):
    """Each rule's column and how many values it holds."""
    out = None
    for name, df in (("txn_damaged", txn_damaged(spark, sf_dir)), ("txn_orders", txn_orders(spark, sf_dir))):
        found = [(rule, resolve(df)) for rule, resolve, _, _ in _RULES]
        counts = df.agg(*(F.count(measured(df, c)).alias(str(i)) if c else F.lit(0).cast("long").alias(str(i)) for i, (_, c) in enumerate(found)))
        rows = counts.select(F.inline(F.array(*(F.struct(F.lit(name).alias("table_name"), F.lit(rule).alias("rule"), F.lit(c).cast("string").alias("column_name"), F.col(str(i)).alias("n_values"))
                                                for i, (rule, c) in enumerate(found)))))
        out = rows if out is None else out.unionByName(rows)
    return out
