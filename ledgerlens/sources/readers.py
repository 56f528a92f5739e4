"""Sources (SRC-1..8): CSV / JSON / parquet readers, ingest report, preview,
reproducible sample and a deterministic synthetic generator."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions.exprs import md5_unit

# Merchant names of the reference's generated transactions.
SYNTH_MERCHANTS = ["Amazon", "Walmart", "Target", "Starbucks"]


def null_na_tokens(df: DataFrame, tokens=C.NA_TOKENS) -> DataFrame:
    """pandas reads a fixed set of NA texts as missing; CSV ``nullValue``
    takes one token, so the rest are nulled per string column."""
    return df.select(*[F.when(F.col(f.name).isin(*tokens), F.lit(None)).otherwise(F.col(f.name)).alias(f.name)
                       if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields])


def _inferred(df: DataFrame) -> DataFrame:
    """Text columns as the narrowest of bigint, double and boolean that every
    value fits (one pass over the file); others stay text."""
    kinds = ("bigint", "double", "boolean")
    misfits = [F.count_if(F.col(f"`{c}`").isNotNull() & F.expr(f"try_cast(`{c}` AS {k})").isNull()).alias(f"{i}_{k}")
               for i, c in enumerate(df.columns) for k in kinds]
    held = [F.count(F.col(f"`{c}`")).alias(f"{i}_n") for i, c in enumerate(df.columns)]
    row = df.agg(*misfits, *held).first()
    out = []
    for i, c in enumerate(df.columns):
        kind = next((k for k in kinds if row[f"{i}_n"] and row[f"{i}_{k}"] == 0), "string")
        # a column without any value is numeric in pandas (all NaN)
        kind = kind if row[f"{i}_n"] else "double"
        out.append(F.col(f"`{c}`").cast(kind).alias(c))
    return df.select(*out)


def _has_quoted_breaks(spark: SparkSession, path: str) -> bool:
    """Whether a line has an odd number of quotes, as the first and last line of a
    field with line breaks have (one pass over the lines, which splits any file)."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             multi_line: bool | None = None) -> DataFrame:
    """SRC-1: header row, doubled quotes, line breaks inside quotes; NA texts
    are missing before types are inferred.  With a declared schema, fields that
    do not parse become null (PERMISSIVE mode).

    Files with quoted line breaks can't be split, each is one task; others are
    split like any text.  Which they are is looked up unless ``multi_line`` says it."""
    multi_line = _has_quoted_breaks(spark, path) if multi_line is None else multi_line
    r = (spark.read.option("header", True).option("mode", "PERMISSIVE").option("quote", '"').option("escape", '"')
         .option("multiLine", multi_line))
    if schema is not None:
        return null_na_tokens(r.schema(schema).csv(path))
    return _inferred(null_na_tokens(r.csv(path)))


def _is_json_array(spark: SparkSession, path: str) -> bool:
    """Whether the first text that is not blank opens an array (reads one line)."""
    first = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.ltrim("value").alias("v")).first()
    return first is not None and first["v"].startswith("[")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
              multi_line: bool | None = None) -> DataFrame:
    """SRC-2: JSON lines, or one JSON array for each file (seen from the first
    line unless ``multi_line`` says).  Records that do not parse fail.

    Lines are split over tasks.  An array is parsed whole by one task, so a file
    of this kind should stay under about a gigabyte; larger tables belong into
    many files or JSON lines."""
    multi_line = _is_json_array(spark, path) if multi_line is None else multi_line
    r = spark.read.option("multiLine", multi_line).option("mode", "FAILFAST")
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def load_transactions(spark: SparkSession, path: str, schema=None, **kw) -> DataFrame:
    """SRC-3: reader by extension; other extensions are rejected."""
    p = path.rstrip("/").lower()
    if p.endswith(".csv"):
        return read_csv(spark, path, schema, **kw)
    if p.endswith(".json"):
        return read_json(spark, path, schema, **kw)
    if p.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError("Unsupported file format. Use CSV or JSON.")


def ingest_report(spark: SparkSession, path: str, df: DataFrame | None = None) -> DataFrame:
    """SRC-4: file name, rows, columns and size in MB (bytes / 1024^2).  The
    size comes from the file listing (``binaryFile`` without its content
    column), so no data is read for it."""
    df = df if df is not None else load_transactions(spark, path)
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length").alias("b"))
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    return rows.crossJoin(size).select(
        F.lit(os.path.basename(path.rstrip("/"))).alias("filename"), "rows",
        F.lit(",".join(df.columns)).alias("columns"),
        (F.col("b") / (1024.0 * 1024.0)).alias("size_mb"))


def preview(df: DataFrame, order_col: str, n: int = C.PREVIEW_ROWS) -> DataFrame:
    """SRC-6: the first n rows in an explicit order."""
    return df.orderBy(order_col).limit(n)


def sample_rows(df: DataFrame, row_id: str, n: int = C.SAMPLE_CAP, seed: int = C.SEED) -> DataFrame:
    """SRC-7: exactly min(n, N) rows, reproducible: the n smallest md5 hashes
    of (row id, seed).  A top-k (per-partition top n, one merge)."""
    key = F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f":{seed}")))
    return df.withColumn("_k", key).orderBy("_k", row_id).limit(n).drop("_k")


def synthetic_transactions(keys: DataFrame, key_col: str, seed: int = C.SEED, n_customers: int = 19,
                           mean_amount: float = 50.0, fraud_rate: float = 0.05,
                           merchants=tuple(SYNTH_MERCHANTS)) -> DataFrame:
    """SRC-8: one generated transaction per key row: uniform customer
    1..n_customers, exponential amount, uniform merchant, Bernoulli label.
    Every draw is an md5 of (key, seed, field), so the output is the same on
    any cluster layout and after any retry."""
    k = F.col(key_col)
    u = lambda field: md5_unit(k, seed=f"{seed}:{field}")
    m = F.array(*[F.lit(x) for x in merchants])
    return keys.select(
        k.cast("bigint").alias("transaction_id"),
        (F.floor(u("customer") * n_customers) + 1).cast("bigint").alias("customer_id"),
        (-mean_amount * F.log(1.0 - u("amount"))).alias("amount"),
        F.element_at(m, (F.floor(u("merchant") * len(merchants)) + 1).cast("int")).alias("merchant"),
        (u("fraud") < fraud_rate).cast("int").alias("is_fraud"))
