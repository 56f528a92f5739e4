"""Column resolution by name and type (PRJ-1..12).

These look only at ``df.schema``; no data is read.  Candidate lists differ per
call site in the reference, so every resolver takes the list as a parameter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
TEMPORAL_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def first_present(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First candidate (in candidate order) that is an exact column name."""
    cols = set(df.columns)
    for c in candidates:
        if c in cols:
            return c
    return None


def first_containing(df: DataFrame, substrings: Sequence[str]) -> str | None:
    """First column (table order) whose lower-case name contains any substring."""
    hits = all_containing(df, substrings)
    return hits[0] if hits else None


def all_containing(df: DataFrame, substrings: Sequence[str]) -> list[str]:
    return [c for c in df.columns if any(s in c.lower() for s in substrings)]


def amount_column(df: DataFrame, candidates: Sequence[str] = C.AMOUNT_CANDIDATES_ANOMALY,
                  required: bool = False) -> str | None:
    col = first_present(df, candidates)
    if col is None and required:
        raise ValueError(f"No amount column found. Available columns: {list(df.columns)}")
    return col


def customer_column(df: DataFrame) -> str | None:
    return first_containing(df, C.CUSTOMER_SUBSTRINGS)


def date_columns_by_name(df: DataFrame) -> list[str]:
    return all_containing(df, C.DATE_SUBSTRINGS)


def first_temporal(df: DataFrame) -> str | None:
    for f in df.schema.fields:
        if isinstance(f.dataType, TEMPORAL_TYPES):
            return f.name
    return None


def time_column_page(df: DataFrame) -> str | None:
    return first_present(df, C.TIME_CANDIDATES_PAGE)


def label_column(df: DataFrame, names: Sequence[str] = C.LABEL_NAMES) -> str | None:
    """First column (table order) equal, ignoring case, to one of ``names``."""
    lowered = {n.lower() for n in names}
    for c in df.columns:
        if c.lower() in lowered:
            return c
    return None


def training_label_column(df: DataFrame) -> str | None:
    """One resolver for train and score: exact names first, then substrings."""
    return label_column(df) or first_containing(df, C.TRAIN_LABEL_SUBSTRINGS)


def stats_label_column(df: DataFrame) -> str | None:
    return first_containing(df, C.STATS_LABEL_SUBSTRINGS)


def category_column(df: DataFrame) -> str | None:
    return first_containing(df, C.CATEGORY_SUBSTRINGS)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns; booleans are not numeric here (pandas excludes them)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def temporal_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, TEMPORAL_TYPES)]


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.FloatType, T.DoubleType))]


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select(*numeric_columns(df))


def id_type(df: DataFrame, c: str) -> str:
    """The type row ids are carried in: bigint for integers, text otherwise."""
    return "bigint" if isinstance(df.schema[c].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else "string"


def with_row_id(df: DataFrame, row_id: str) -> DataFrame:
    """``df`` with a row identity: the column if it exists, else a text made of
    the row's content hash and, among equal rows, a running number.  Equal rows
    are interchangeable, so a retry gives the same table."""
    if row_id in df.columns:
        return df
    content = F.md5(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}))
    copy = F.row_number().over(Window.partitionBy("_content").orderBy(F.lit(0)))
    return (df.withColumn("_content", content).withColumn(row_id, F.concat_ws("-", "_content", copy)).drop("_content"))
