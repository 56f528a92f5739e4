"""Registered cleaning queries (CLN-1..10) on the damaged transaction view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import ts_text, ts_text_micros
from ..operators import clean as K
from ..sources.views import SQL_TXN, SQL_TXN_DIRTY, txn, txn_dirty
from .catalog import register

DEDUP = "dedup AS (SELECT DISTINCT * FROM txn_dirty)"
FILLED = DEDUP + """,
med AS (SELECT quantile_cont(amount, 0.5) AS m_amount FROM dedup),
mode_cat AS (SELECT category AS m_cat FROM dedup WHERE category IS NOT NULL
             GROUP BY category ORDER BY count(*) DESC, category LIMIT 1),
filled AS (SELECT transaction_id, customer_id, coalesce(amount, m_amount) AS amount,
                  coalesce(category, (SELECT m_cat FROM mode_cat), 'Unknown') AS category,
                  transaction_date, is_fraud
           FROM dedup, med)"""


@register("dedupe_rows", f"""WITH {SQL_TXN_DIRTY}, {DEDUP}
SELECT transaction_id, customer_id, round(amount, 6) AS amount, category, transaction_date, is_fraud FROM dedup""")
def q_dedupe_rows(spark, sf_dir):
    d = K.dedupe(txn_dirty(spark, sf_dir))
    return d.select("transaction_id", "customer_id", F.round("amount", 6).alias("amount"), "category",
                    "transaction_date", "is_fraud")


@register("null_profile", f"""WITH {SQL_TXN_DIRTY}, {FILLED}
SELECT (SELECT count(*) FROM txn_dirty) AS rows_before,
       (SELECT count(*) FROM dedup) AS rows_after,
       (SELECT count(*) FROM txn_dirty) - (SELECT count(*) FROM dedup) AS duplicates_removed,
       (SELECT count(*) FILTER (WHERE amount IS NULL) + count(*) FILTER (WHERE category IS NULL) FROM dedup) AS nulls_before,
       (SELECT count(*) FILTER (WHERE amount IS NULL) + count(*) FILTER (WHERE category IS NULL) FROM filled) AS nulls_after""")
def q_null_profile(spark, sf_dir):
    _, rep = K.clean(txn_dirty(spark, sf_dir), with_report=True)
    return spark.createDataFrame(
        [(rep.rows_before, rep.rows_after, rep.duplicates, rep.nulls_before, rep.nulls_after)],
        "rows_before bigint, rows_after bigint, duplicates_removed bigint, nulls_before bigint, nulls_after bigint")


@register("impute_median", f"""WITH {SQL_TXN_DIRTY}, {FILLED}
SELECT transaction_id, customer_id, round(amount, 6) AS amount, is_fraud FROM filled""")
def q_impute_median(spark, sf_dir):
    d = K.impute_median(K.dedupe(txn_dirty(spark, sf_dir)))
    return d.select("transaction_id", "customer_id", F.round("amount", 6).alias("amount"), "is_fraud")


@register("impute_mode", f"""WITH {SQL_TXN_DIRTY}, {FILLED}
SELECT transaction_id, category FROM filled""")
def q_impute_mode(spark, sf_dir):
    return K.impute_mode(K.dedupe(txn_dirty(spark, sf_dir))).select("transaction_id", "category")


@register("parse_dates", f"""WITH {SQL_TXN_DIRTY}, {FILLED}
SELECT transaction_id, strftime(try_cast(transaction_date AS timestamp), '%Y-%m-%d %H:%M:%S') AS transaction_date
FROM filled""")
def q_parse_dates(spark, sf_dir):
    d = K.parse_dates(K.dedupe(txn_dirty(spark, sf_dir)))
    return d.select("transaction_id", ts_text(F.col("transaction_date")).alias("transaction_date"))


@register("parse_epoch", f"""WITH {SQL_TXN}
SELECT transaction_id,
       strftime(make_timestamp(cast(floor(epoch(transaction_date) / 1000) AS bigint)), '%Y-%m-%d %H:%M:%S.%f') AS unix_time
FROM txn""")
def q_parse_epoch(spark, sf_dir):
    t = txn(spark, sf_dir).select("transaction_id", F.expr(
        "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', transaction_date)").alias("unix_time"))
    d = K.parse_dates(t)
    return d.select("transaction_id", ts_text_micros(F.col("unix_time")).alias("unix_time"))


@register("clean_table", f"""WITH {SQL_TXN_DIRTY}, {FILLED}
SELECT transaction_id, customer_id, round(amount, 6) AS amount, category,
       strftime(try_cast(transaction_date AS timestamp), '%Y-%m-%d %H:%M:%S') AS transaction_date, is_fraud
FROM filled""")
def q_clean_table(spark, sf_dir):
    d = K.clean(txn_dirty(spark, sf_dir))
    return d.select("transaction_id", "customer_id", F.round("amount", 6).alias("amount"), "category",
                    ts_text(F.col("transaction_date")).alias("transaction_date"), "is_fraud")


# --- the page's path: amount arrives as text with bad tokens -------------

def txn_text(spark, sf_dir):
    t = txn(spark, sf_dir)
    i = F.col("transaction_id")
    amt = (F.when(i % 31 == 0, "n/a").when(i % 37 == 0, "inf").when(i % 41 == 0, "-inf")
           .when(i % 43 == 0, "NaN").otherwise(F.col("amount").cast("string")))
    return t.withColumn("amount", amt)


SQL_TXN_TEXT = SQL_TXN + """,
txn_text AS (
  SELECT transaction_id, customer_id,
         CASE WHEN transaction_id % 31 = 0 THEN 'n/a' WHEN transaction_id % 37 = 0 THEN 'inf'
              WHEN transaction_id % 41 = 0 THEN '-inf' WHEN transaction_id % 43 = 0 THEN 'NaN'
              ELSE cast(amount AS varchar) END AS amount,
         category, transaction_date, is_fraud
  FROM txn),
coerced AS (SELECT * REPLACE (try_cast(amount AS double) AS amount) FROM txn_text),
finite AS (SELECT * REPLACE (CASE WHEN isnan(amount) OR isinf(amount) THEN NULL ELSE amount END AS amount) FROM coerced),
amed AS (SELECT quantile_cont(amount, 0.5) AS m FROM finite),
imputed AS (SELECT finite.* REPLACE (coalesce(amount, m) AS amount), amount IS NULL AS was_imputed FROM finite, amed),
sstat AS (SELECT avg(amount) AS m, stddev_pop(amount) AS s FROM imputed),
page AS (SELECT imputed.*, (amount - m) / coalesce(nullif(s, 0), 1) AS Scaled_Amount FROM imputed, sstat)"""


@register("coerce_numeric", f"""WITH {SQL_TXN_TEXT}
SELECT transaction_id, round(amount, 6) AS amount FROM coerced""")
def q_coerce_numeric(spark, sf_dir):
    d = K.coerce_numeric(txn_text(spark, sf_dir), "amount")
    return d.select("transaction_id", F.round("amount", 6).alias("amount"))


@register("drop_infinity", f"""WITH {SQL_TXN_TEXT}
SELECT transaction_id, round(amount, 6) AS amount FROM finite""")
def q_drop_infinity(spark, sf_dir):
    d = K.drop_infinity(K.coerce_numeric(txn_text(spark, sf_dir), "amount"))
    return d.select("transaction_id", F.round("amount", 6).alias("amount"))


@register("impute_amount", f"""WITH {SQL_TXN_TEXT}
SELECT transaction_id, round(amount, 6) AS amount, was_imputed FROM imputed""")
def q_impute_amount(spark, sf_dir):
    d = K.drop_infinity(K.coerce_numeric(txn_text(spark, sf_dir), "amount"))
    out, _, _ = K.impute_amount(d, "amount")
    return out.select("transaction_id", F.round("amount", 6).alias("amount"), "was_imputed")


@register("impute_amount_stats", f"""WITH {SQL_TXN_TEXT}
SELECT count(*) FILTER (WHERE was_imputed) AS n_imputed, round(any_value(m), 6) AS median_value
FROM imputed, amed""")
def q_impute_amount_stats(spark, sf_dir):
    d = K.drop_infinity(K.coerce_numeric(txn_text(spark, sf_dir), "amount"))
    _, n, med = K.impute_amount(d, "amount")
    return spark.createDataFrame([(n, round(med, 6) if med is not None else None)],
                                 "n_imputed bigint, median_value double")


@register("zero_fill", f"""WITH {SQL_TXN_DIRTY}
SELECT transaction_id, customer_id, round(coalesce(amount, 0), 6) AS amount, is_fraud FROM txn_dirty""")
def q_zero_fill(spark, sf_dir):
    d = K.zero_fill(txn_dirty(spark, sf_dir))
    return d.select("transaction_id", "customer_id", F.round("amount", 6).alias("amount"), "is_fraud")


@register("page_processed", f"""WITH {SQL_TXN_TEXT}
SELECT transaction_id, customer_id, is_fraud, round(Scaled_Amount, 6) AS Scaled_Amount FROM page""")
def q_page_processed(spark, sf_dir):
    processed, _, _, _ = K.page_load(txn_text(spark, sf_dir))
    return processed.select("transaction_id", "customer_id", "is_fraud",
                            F.round("Scaled_Amount", 6).alias("Scaled_Amount"))


@register("fingerprint", f"""WITH {SQL_TXN_TEXT}
SELECT count(*) AS n_rows,
       cast(sum(cast(('0x' || substr(md5(concat_ws('|', cast(transaction_id AS varchar), cast(customer_id AS varchar),
            cast(is_fraud AS varchar), cast(cast(round(Scaled_Amount, 6) AS decimal(38,6)) AS varchar))), 1, 12)) AS bigint)) AS varchar) AS fingerprint
FROM page""")
def q_fingerprint(spark, sf_dir):
    processed, _, _, _ = K.page_load(txn_text(spark, sf_dir))
    return K.fingerprint(processed)
