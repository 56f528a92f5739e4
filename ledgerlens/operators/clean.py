"""Cleaning: dedupe, null handling, coercion, date parsing (CLN-1..10).

Order of ``clean`` is fixed: dedupe -> numeric median fill -> string mode
fill -> date parse.  Fill values are computed after the dedupe, all numeric
medians in one narrowing pass (``exact_quantiles``) and all modes in one
grouped aggregate, never one job per column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions.columns import (amount_column, date_columns_by_name, float_columns,
                                 numeric_columns, string_columns, time_column_page)
from ..functions.quantiles import exact_modes, exact_quantiles, quantiles
from ..session import ensure_checkpoint_dir


def is_missing(df: DataFrame, c: str) -> Column:
    """pandas' notion of missing: null, and NaN for floating columns."""
    if c in float_columns(df):
        return F.col(c).isNull() | F.isnan(c)
    return F.col(c).isNull()


def dedupe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """CLN-1: exact duplicate rows removed (null equals null)."""
    return df.dropDuplicates(list(cols) if cols else df.columns)


def null_counts(df: DataFrame) -> dict[str, int]:
    """Missing values per column, one aggregate."""
    if not df.columns:
        return {}
    row = df.agg(*[F.count_if(is_missing(df, c)).alias(c) for c in df.columns]).first()
    return {c: int(row[c]) for c in df.columns}


def _nulls_to_none(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    floats = set(float_columns(df))
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c)
                       for c in df.columns]) if floats & set(cols) else df


def impute_median(df: DataFrame, exclude: Sequence[str] = (), counts: dict | None = None, rank_error: float | None = None) -> DataFrame:
    """CLN-3: every numeric column holding a missing value gets its exact
    (interpolated) median, or with a ``rank_error`` a value that near to it, from
    one pass; an all-missing column stays null.  Integer columns
    with missing values become double first, as in pandas."""
    counts = counts if counts is not None else null_counts(df)
    targets = [c for c in numeric_columns(df, exclude) if counts.get(c, 0) > 0]
    if not targets:
        return df
    med = quantiles(df, [(c, 0.5) for c in targets], rank_error)
    df = _nulls_to_none(df, targets)
    out = []
    for f in df.schema.fields:
        if f.name in targets:
            m = med[(f.name, 0.5)]
            c = F.col(f.name).cast("double")
            out.append((F.coalesce(c, F.lit(m)) if m is not None else c).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def impute_mode(df: DataFrame, exclude: Sequence[str] = (), counts: dict | None = None,
                default: str = "Unknown") -> DataFrame:
    """CLN-4: every string column holding a null gets its most frequent value
    (ties: smallest); a column without any value gets ``default``."""
    counts = counts if counts is not None else null_counts(df)
    targets = [c for c in string_columns(df, exclude) if counts.get(c, 0) > 0]
    if not targets:
        return df
    modes = exact_modes(df, targets)
    return df.select(*[F.coalesce(F.col(c), F.lit(default if modes.get(c) is None else modes[c])).alias(c) if c in targets
                       else F.col(c) for c in df.columns])


def parse_dates(df: DataFrame, cols: Sequence[str] | None = None, numeric_epoch: bool = True) -> DataFrame:
    """CLN-5: name-selected date/time columns become timestamps; text that
    does not parse becomes null.  Numbers are read as epoch nanoseconds, as
    pandas does (``numeric_epoch=False`` leaves them alone)."""
    cols = list(cols) if cols is not None else date_columns_by_name(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = set(numeric_columns(df))
    out = []
    for c in df.columns:
        if c not in cols:
            out.append(F.col(c))
        elif isinstance(types[c], T.StringType):
            # naive wall-clock time, as pandas gives: independent of the session time zone
            out.append(F.expr(f"try_cast(`{c}` AS TIMESTAMP_NTZ)").alias(c))
        elif c in numeric and numeric_epoch:
            out.append(F.expr(f"timestampadd(MICROSECOND, CAST(floor(`{c}` / 1000) AS BIGINT), "
                              f"TIMESTAMP_NTZ'1970-01-01 00:00:00')").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


@dataclass
class CleanReport:
    rows_before: int
    rows_after: int
    nulls_before: int
    nulls_after: int

    @property
    def duplicates(self) -> int:
        return self.rows_before - self.rows_after


def clean(df: DataFrame, exclude: Sequence[str] = (), with_report: bool = False):
    """CLN-1..5 in the reference's order.  The deduped frame feeds the null
    count, the median narrowing and the mode pass, so it is checkpointed
    (reliable, under ``spark.checkpoint.dir``): the dedupe shuffle runs once
    and a lost executor does not send the job back to the raw files."""
    ensure_checkpoint_dir(df.sparkSession)
    deduped = dedupe(df).checkpoint(eager=True)
    counts = null_counts(deduped)
    filled = impute_mode(impute_median(deduped, exclude, counts), exclude, counts)
    out = parse_dates(filled)
    if not with_report:
        return out
    after = null_counts(filled)
    rep = CleanReport(rows_before=df.count(), rows_after=deduped.count(),
                      nulls_before=sum(counts.values()), nulls_after=sum(after.values()))
    return out, rep


# --- the page's loading path (CLN-6..10) --------------------------------

def coerce_numeric(df: DataFrame, col: str) -> DataFrame:
    """CLN-6: text to double, values that do not parse become null."""
    return df.withColumn(col, F.expr(f"try_cast(`{col}` AS double)"))


def drop_infinity(df: DataFrame) -> DataFrame:
    """CLN-7: +-infinity (and NaN) become null in every floating column."""
    inf = float("inf")
    floats = set(float_columns(df))
    return df.select(*[F.when(F.isnan(c) | F.col(c).isin(inf, -inf), F.lit(None)).otherwise(F.col(c))
                       .cast(df.schema[c].dataType).alias(c) if c in floats else F.col(c)
                       for c in df.columns])


def impute_amount(df: DataFrame, col: str) -> tuple[DataFrame, int, float | None]:
    """CLN-8: median fill of one column; returns (frame, imputed count, median)."""
    missing = df.agg(F.count_if(is_missing(df, col)).alias("n")).first()["n"]
    if missing == 0:
        return df.withColumn("was_imputed", F.lit(False)), 0, None
    med = exact_quantiles(df, [(col, 0.5)])[(col, 0.5)]
    flagged = df.withColumn("was_imputed", is_missing(df, col))
    return flagged.withColumn(col, F.coalesce(F.col(col).cast("double"), F.lit(med))), int(missing), med


def zero_fill(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """CLN-9: remaining numeric nulls (and NaN) become 0."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    return df.na.fill(0, subset=cols) if cols else df


def fingerprint(df: DataFrame) -> DataFrame:
    """CLN-10: order-insensitive content hash of a table: the sum over rows of
    the first 48 bits of md5(row text), as a decimal string, plus the row
    count.  Doubles are rendered at 6 decimals so both engines agree."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.round(c, 6).cast("decimal(38,6)")
        parts.append(F.coalesce(c.cast("string"), F.lit("\\N")))
    row_hash = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(row_hash).cast("string").alias("fingerprint"))


def page_load(df: DataFrame, row_id: str | None = None):
    """The page's loading path: resolve the amount column (raises if absent),
    coerce it, null infinities, median-fill it, add ``Scaled_Amount``, drop
    the time and amount columns, keep numbers (and ``row_id``), fill the rest
    with 0.  Returns (processed, original, imputed count, median)."""
    from .features import scaled_amount
    amt = amount_column(df, C.AMOUNT_CANDIDATES_PAGE, required=True)
    df = drop_infinity(coerce_numeric(df, amt))
    df, n_imp, med = impute_amount(df, amt)
    df = scaled_amount(df.drop("was_imputed"), amt)
    time_col = time_column_page(df) or "Time"
    processed = df.drop(time_col, amt)
    numbers = numeric_columns(processed)
    extra = [row_id] if row_id and row_id in processed.columns and row_id not in numbers else []
    return zero_fill(processed.select(*extra, *numbers), numbers), df, n_imp, med
