"""Transaction views over the driver's test tables, with their SQL twins.

The reference works on one flat table of card transactions.  The test tables
are mapped onto that shape (see FIXTURES.md section C); each view has a Spark
form and the same definition as DuckDB SQL so the oracle checks the same
input.  All damage in ``txn_dirty`` is deterministic (functions of the id), so
the two engines see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import md5_unit, ts_text
from ..session import table_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("transaction_id"),
        F.col("user_id").alias("customer_id"),
        F.col("value").alias("amount"),
        F.col("event_type").alias("category"),
        F.col("ts").alias("transaction_date"),
        ((F.col("value") > 120) & (F.hour("ts") < 12)).cast("int").alias("is_fraud"),
    )


def txn_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("category"),
        F.col("o_orderdate").alias("transaction_date"),
    )


def txn_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = txn(spark, sf_dir)
    i = F.col("transaction_id")
    damaged = t.select(
        "transaction_id", "customer_id",
        F.when(i % 17 == 0, F.lit(None).cast("double")).otherwise(F.col("amount")).alias("amount"),
        F.when(i % 23 == 0, F.lit(None).cast("string")).otherwise(F.col("category")).alias("category"),
        F.when(i % 29 == 0, F.lit("bad")).otherwise(ts_text(F.col("transaction_date"))).alias("transaction_date"),
        "is_fraud",
    )
    return damaged.unionByName(damaged.where(i % 50 == 0))


def txn_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """txn with missing and NaN amounts, missing categories and missing dates,
    still typed (what a cleaned or badly parsed table looks like)."""
    t = txn(spark, sf_dir)
    i = F.col("transaction_id")
    return t.select(
        "transaction_id", "customer_id",
        F.when(i % 17 == 0, F.lit(None).cast("double")).when(i % 31 == 0, F.lit(float("nan"))).otherwise(F.col("amount")).alias("amount"),
        F.when(i % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("category")).alias("category"),
        F.when(i % 2 == 0, F.lit(None).cast(t.schema["transaction_date"].dataType)).otherwise(F.col("transaction_date")).alias("transaction_date"),
        "is_fraud")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """txn plus a deterministic pseudo model output, so the metric and report
    operators are exact-checked apart from any model."""
    t = txn(spark, sf_dir)
    p = md5_unit("transaction_id")
    return t.select(
        "*",
        p.alias("fraud_probability"),
        (p > 0.5).cast("int").alias("fraud_prediction"),
        (md5_unit("transaction_id", seed="iforest") - 1.0).alias("anomaly_raw"),
    )


# --- SQL twins (DuckDB) --------------------------------------------------

SQL_MD5_UNIT = "(cast(('0x' || substr(md5({x}), 1, 8)) as bigint) / 4294967296.0)"


def sql_md5_unit(expr: str, seed: str | None = None) -> str:
    x = f"cast({expr} as varchar)"
    if seed is not None:
        x = f"({x} || ':{seed}')"
    return SQL_MD5_UNIT.format(x=x)


SQL_TXN = """txn AS (
  SELECT event_id AS transaction_id, user_id AS customer_id, value AS amount,
         event_type AS category, ts AS transaction_date,
         cast(value > 120 AND hour(ts) < 12 AS integer) AS is_fraud
  FROM events)"""

SQL_TXN_ORDERS = """txn_orders AS (
  SELECT o_orderkey AS transaction_id, o_custkey AS customer_id, o_totalprice AS amount,
         o_orderpriority AS category, o_orderdate AS transaction_date
  FROM orders)"""

SQL_TXN_DIRTY = SQL_TXN + """,
damaged AS (
  SELECT transaction_id, customer_id,
         CASE WHEN transaction_id % 17 = 0 THEN NULL ELSE amount END AS amount,
         CASE WHEN transaction_id % 23 = 0 THEN NULL ELSE category END AS category,
         CASE WHEN transaction_id % 29 = 0 THEN 'bad'
              ELSE strftime(transaction_date, '%Y-%m-%d %H:%M:%S') END AS transaction_date,
         is_fraud
  FROM txn),
txn_dirty AS (
  SELECT * FROM damaged UNION ALL SELECT * FROM damaged WHERE transaction_id % 50 = 0)"""

#: NaN amounts are null in the twin: every operator must treat them alike.
SQL_TXN_DAMAGED = SQL_TXN + """,
txn_damaged AS (
  SELECT transaction_id, customer_id,
         CASE WHEN transaction_id % 17 = 0 OR transaction_id % 31 = 0 THEN NULL ELSE amount END AS amount,
         CASE WHEN transaction_id % 3 = 0 THEN NULL ELSE category END AS category,
         CASE WHEN transaction_id % 2 = 0 THEN NULL ELSE transaction_date END AS transaction_date, is_fraud
  FROM txn)"""

SQL_SCORED = SQL_TXN + f""",
scored AS (
  SELECT *, {sql_md5_unit('transaction_id')} AS fraud_probability,
         cast({sql_md5_unit('transaction_id')} > 0.5 AS integer) AS fraud_prediction,
         {sql_md5_unit('transaction_id', 'iforest')} - 1.0 AS anomaly_raw
  FROM txn)"""
