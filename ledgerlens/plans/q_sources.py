"""Registered source/sink queries (SRC-1..8, SNK-1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import r6, ts_text
from ..operators import clean as K
from ..session import scratch_path
from ..sources import readers as RD
from ..sources.sinks import write_csv, write_json
from ..sources.views import (SQL_TXN, SQL_TXN_DIRTY, SQL_TXN_ORDERS, read_table, sql_md5_unit, txn,
                             txn_dirty, txn_orders)
from .catalog import register
from .q_clean import FILLED

DIRTY_SCHEMA = ("transaction_id bigint, customer_id bigint, amount double, category string, "
                "transaction_date string, is_fraud int")
ORDERS_SCHEMA = ("transaction_id bigint, customer_id bigint, amount double, category string, "
                 "transaction_date timestamp_ntz")


@register("csv_roundtrip", f"""WITH {SQL_TXN_DIRTY}
SELECT transaction_id, customer_id, round(amount, 6) AS amount, category, transaction_date, is_fraud FROM txn_dirty""")
def q_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "txn_dirty") + ".csv"
    write_csv(txn_dirty(spark, sf_dir), path)
    back = RD.load_transactions(spark, path, DIRTY_SCHEMA)
    return back.withColumn("amount", r6(F.col("amount")))


@register("json_roundtrip", f"""WITH {SQL_TXN_ORDERS}
SELECT transaction_id, customer_id, round(amount, 6) AS amount, category,
       strftime(transaction_date, '%Y-%m-%d %H:%M:%S') AS transaction_date FROM txn_orders""")
def q_json_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "txn_orders") + ".json"
    write_json(txn_orders(spark, sf_dir), path)
    back = RD.load_transactions(spark, path, ORDERS_SCHEMA)
    return back.select("transaction_id", "customer_id", r6(F.col("amount")).alias("amount"), "category",
                       ts_text(F.col("transaction_date")).alias("transaction_date"))


@register("csv_sink", f"""WITH {SQL_TXN_DIRTY}, {FILLED}
SELECT transaction_id, customer_id, round(amount, 6) AS amount, category,
       strftime(try_cast(transaction_date AS timestamp), '%Y-%m-%d %H:%M:%S') AS transaction_date, is_fraud
FROM filled""")
def q_csv_sink(spark, sf_dir):
    cleaned = K.clean(txn_dirty(spark, sf_dir))
    path = scratch_path(spark, "processed") + ".csv"
    write_csv(cleaned, path)
    back = RD.read_csv(spark, path, "transaction_id bigint, customer_id bigint, amount double, category string, "
                                    "transaction_date timestamp_ntz, is_fraud int")
    return back.select("transaction_id", "customer_id", r6(F.col("amount")).alias("amount"), "category",
                       ts_text(F.col("transaction_date")).alias("transaction_date"), "is_fraud")


# texts with doubled quotes, commas and line breaks, and an NA word among the amounts
SQL_QUOTED = """SELECT o_orderkey AS transaction_id,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE round(o_totalprice, 6) END AS amount,
       'he said "' || o_orderpriority || '", ok' || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || 'next line' ELSE '' END AS note
FROM orders"""


def _quoted(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("transaction_id"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("amount"),
        F.concat(F.lit('he said "'), "o_orderpriority", F.lit('", ok'),
                 F.when(F.col("o_orderkey") % 3 == 0, F.lit("\nnext line")).otherwise(F.lit(""))).alias("note"))


@register("csv_quoted", SQL_QUOTED)
def q_csv_quoted(spark, sf_dir):
    path = scratch_path(spark, "quoted") + ".csv"
    worded = _quoted(spark, sf_dir).withColumn("amount", F.coalesce(F.col("amount").cast("string"), F.lit("NA")))
    write_csv(worded, path)
    back = RD.load_transactions(spark, path)                       # types from the file: the NA word is missing, not text
    return back.select("transaction_id", r6(F.col("amount")).alias("amount"), "note")


@register("json_array", SQL_QUOTED)
def q_json_array(spark, sf_dir):
    path = scratch_path(spark, "array") + ".json"
    rows = _quoted(spark, sf_dir)
    files = max(8, rows.count() // 10_000)
    # each file is one array over many lines, of 10,000 rows or so
    text = rows.select(F.to_json(F.struct(*rows.columns)).alias("j"), F.pmod(F.xxhash64("transaction_id"), F.lit(files)).alias("part"))
    arrays = text.groupBy("part").agg(F.concat_ws(",\n  ", F.collect_list("j")).alias("j"))
    arrays.select("part", F.concat(F.lit("[\n  "), "j", F.lit("\n]")).alias("value")).write.partitionBy("part").text(path)
    return RD.load_transactions(spark, path, "transaction_id bigint, amount double, note string").select(
        "transaction_id", r6(F.col("amount")).alias("amount"), "note")


@register("ingest_rows", f"""SELECT count(*) AS rows, 'event_id,ts,user_id,event_type,value,props' AS columns FROM events""")
def q_ingest_rows(spark, sf_dir):
    from ..session import table_path
    return RD.ingest_report(spark, table_path(sf_dir, "events")).select("rows", "columns")


@register("ingest_size_check", "SELECT true AS size_is_the_files, true AS name_is_the_files, count(*) AS rows FROM events")
def q_ingest_size_check(spark, sf_dir):
    """The report's size is what the file system says of the files."""
    from ..session import table_path
    path = spark._jvm.org.apache.hadoop.fs.Path(table_path(sf_dir, "events"))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    held = sum(f.getLen() for f in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "*.parquet"))) if fs.getFileStatus(path).isDirectory() else fs.getFileStatus(path).getLen()
    rep = RD.ingest_report(spark, table_path(sf_dir, "events"))
    return rep.select((F.abs(F.col("size_mb") - held / 1048576.0) < 1e-9).alias("size_is_the_files"), (F.col("filename") == "events.parquet").alias("name_is_the_files"), "rows")


@register("ingest_report")
def q_ingest_report(spark, sf_dir):
    from ..session import table_path
    return RD.ingest_report(spark, table_path(sf_dir, "events"))


@register("preview_rows", f"""WITH {SQL_TXN}
SELECT transaction_id, customer_id, round(amount, 6) AS amount, category,
       strftime(transaction_date, '%Y-%m-%d %H:%M:%S') AS transaction_date, is_fraud
FROM txn ORDER BY transaction_id LIMIT 10""")
def q_preview_rows(spark, sf_dir):
    p = RD.preview(txn(spark, sf_dir), "transaction_id")
    return p.select("transaction_id", "customer_id", r6(F.col("amount")).alias("amount"), "category",
                    ts_text(F.col("transaction_date")).alias("transaction_date"), "is_fraud")


@register("sample_rows", f"""WITH {SQL_TXN}
SELECT transaction_id, customer_id, round(amount, 6) AS amount, category,
       strftime(transaction_date, '%Y-%m-%d %H:%M:%S') AS transaction_date, is_fraud
FROM txn ORDER BY md5(cast(transaction_id AS varchar) || ':42'), transaction_id LIMIT 1000""")
def q_sample_rows(spark, sf_dir):
    p = RD.sample_rows(txn(spark, sf_dir), "transaction_id")
    return p.select("transaction_id", "customer_id", r6(F.col("amount")).alias("amount"), "category",
                    ts_text(F.col("transaction_date")).alias("transaction_date"), "is_fraud")


def _u(field: str) -> str:
    return sql_md5_unit("event_id", f"42:{field}")


@register("synthetic_transactions", f"""SELECT event_id AS transaction_id,
       cast(floor({_u('customer')} * 19) + 1 AS bigint) AS customer_id,
       round(-50.0 * ln(1.0 - {_u('amount')}), 6) AS amount,
       ['Amazon', 'Walmart', 'Target', 'Starbucks'][cast(floor({_u('merchant')} * 4) + 1 AS integer)] AS merchant,
       cast({_u('fraud')} < 0.05 AS integer) AS is_fraud
FROM events""")
def q_synthetic_transactions(spark, sf_dir):
    s = RD.synthetic_transactions(read_table(spark, sf_dir, "events"), "event_id")
    return s.withColumn("amount", r6(F.col("amount")))
