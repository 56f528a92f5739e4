"""Feature engineering (FEA-1..7, PRJ-13/14).

Dictionaries (one-hot values, label codes) are small by construction or by a
checked size and are joined with a broadcast only under that check; scaler
statistics are one aggregate row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import (first_temporal, label_column, numeric_columns, string_columns,
                                 temporal_columns)
from ..config import LIMITS
from ..functions.exprs import measured
from ..functions.indexing import sorted_dictionary
from ..session import stored


def calendar_features(df: DataFrame, date_col: str | None = None) -> DataFrame:
    """FEA-1: hour, day_of_week (Monday=0), is_weekend, month from the first
    timestamp column (a row without a date is no weekend); same-named columns
    are overwritten."""
    date_col = date_col or first_temporal(df)
    if date_col is None:
        return df
    d = F.col(date_col)
    return (df.withColumn("hour", F.hour(d)).withColumn("day_of_week", F.weekday(d))
            .withColumn("is_weekend", F.coalesce(F.col("day_of_week").isin(5, 6), F.lit(False)).cast("int"))
            .withColumn("month", F.month(d)))


def one_hot_values(df: DataFrame, max_columns: int = C.ONE_HOT_MAX_COLUMNS,
                   max_values: int = C.ONE_HOT_MAX_VALUES) -> dict[str, list[str]]:
    """Sorted distinct values of the first ``max_columns`` string columns that
    have fewer than ``max_values`` distinct non-null values."""
    cols = string_columns(df)[:max_columns]
    if not cols:
        return {}
    # a sketch keeps columns of many values out; the others' values are fetched exactly
    near = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).first()
    few = [c for c in cols if near[c] < 2 * max_values + 10]
    if not few:
        return {}
    kv = F.inline(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in few]))
    vals: dict[str, list[str]] = {c: [] for c in few}
    for r in df.select(kv).where(F.col("v").isNotNull()).distinct().collect():   # about 2 max_values per column
        vals[r["k"]].append(r["v"])
    return {c: sorted(v) for c, v in vals.items() if len(v) < max_values}


def one_hot(df: DataFrame, values: dict[str, list[str]] | None = None, max_columns: int = C.ONE_HOT_MAX_COLUMNS,
            max_values: int = C.ONE_HOT_MAX_VALUES) -> DataFrame:
    """FEA-2: ``{col}_{value}`` booleans, first sorted value dropped; a null
    row is all false; the original column is kept.  Only the first
    ``max_columns`` text columns are looked at, and of those the ones with
    fewer than ``max_values`` values (the reference's rule; raise the arguments
    for more)."""
    values = values if values is not None else one_hot_values(df, max_columns, max_values)
    extra = []
    for c, vs in values.items():
        for v in vs[1:]:
            extra.append(F.coalesce(F.col(c) == F.lit(v), F.lit(False)).alias(f"{c}_{v}"))
    return df.select("*", *extra) if extra else df


def timestamp_expand(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """FEA-3: each timestamp column becomes _hour, _day, _month, _dayofweek."""
    for c in (temporal_columns(df) if cols is None else cols):
        d = F.col(c)
        df = (df.withColumn(f"{c}_hour", F.hour(d)).withColumn(f"{c}_day", F.dayofmonth(d))
              .withColumn(f"{c}_month", F.month(d)).withColumn(f"{c}_dayofweek", F.weekday(d))
              .drop(c))
    return df


def _as_label_text(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit("nan"))


def fit_label_encoders(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, tuple[DataFrame, int]]:
    """FEA-4 fit: per string column, sorted distinct texts -> 0..k-1.

    The distinct (column, text) pairs of all columns are found in one pass and
    stored; columns of up to ``LIMITS.dictionary_local`` texts are numbered in
    one more, each by itself; larger ones by ranges (``sorted_dictionary``)."""
    cols = list(cols) if cols is not None else string_columns(df)
    if not cols:
        return {}
    pairs = F.inline(F.array(*(F.struct(F.lit(c).alias("column"), _as_label_text(c).alias("value")) for c in cols)))
    texts = stored(df.select(pairs).distinct(), "labels")
    sizes = {r["column"]: r["n"] for r in texts.groupBy("column").agg(F.count("*").alias("n")).collect()}
    few = [c for c in cols if sizes.get(c, 0) <= LIMITS.dictionary_local]
    code = (F.row_number().over(Window.partitionBy("column").orderBy("value")) - 1).cast("bigint").alias("code")
    codes = stored(texts.where(F.col("column").isin(few)).select("column", "value", code), "label-codes") if few else None
    return {c: (codes.where(F.col("column") == c).select("value", "code"), sizes.get(c, 0)) if c in few
            else sorted_dictionary(texts.where(F.col("column") == c).select("value")) for c in cols}


def apply_label_encoders(df: DataFrame, encoders: dict[str, tuple[DataFrame, int | None]],
                         unseen: int = -1) -> DataFrame:
    """FEA-4 transform: code of the text; unseen text -> ``unseen``."""
    out = df
    for c, (dic, size) in encoders.items():
        if c not in out.columns:
            continue
        d = dic.select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_c_{c}"))
        if size is not None and size <= LIMITS.dictionary_broadcast:
            d = F.broadcast(d)
        out = (out.join(d, _as_label_text(c) == F.col(f"_v_{c}"), "left")
               .withColumn(c, F.coalesce(F.col(f"_c_{c}"), F.lit(unseen).cast("bigint")))
               .drop(f"_v_{c}", f"_c_{c}"))
    return out


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
    """FEA-5 fit: mean and population std per column, one aggregate row."""
    if not cols:
        return {}
    row = df.agg(*[F.avg(measured(df, c)).alias(f"m_{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(measured(df, c)).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"m_{i}"], row[f"s_{i}"]) for i, c in enumerate(cols)}


def apply_scaler(df: DataFrame, stats: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """FEA-5 transform: (x - mean) / std, a zero std divides by 1."""
    def scaled(c):
        m, s = stats[c]
        div = s if s not in (None, 0.0) else 1.0
        return ((measured(df, c).cast("double") - F.lit(m if m is not None else 0.0)) / F.lit(div)).alias(c)
    return df.select(*[scaled(c) if c in stats else F.col(c) for c in df.columns])


def standard_scale(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """FEA-5 as one lazy plan: one-row statistics broadcast to every row."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    stats = df.agg(*[F.avg(measured(df, c)).alias(f"_m_{i}") for i, c in enumerate(cols)],
                   *[F.stddev_pop(measured(df, c)).alias(f"_s_{i}") for i, c in enumerate(cols)])
    j = df.crossJoin(F.broadcast(stats))
    sel = []
    idx = {c: i for i, c in enumerate(cols)}
    for c in df.columns:
        if c in idx:
            i = idx[c]
            div = F.coalesce(F.when(F.col(f"_s_{i}") != 0, F.col(f"_s_{i}")), F.lit(1.0))
            sel.append(((measured(df, c).cast("double") - F.col(f"_m_{i}")) / div).alias(c))
        else:
            sel.append(F.col(c))
    return j.select(*sel)


def scaled_amount(df: DataFrame, amount_col: str, name: str = "Scaled_Amount") -> DataFrame:
    """FEA-6: z-scaled amount (population std) as a new column."""
    x = measured(df, amount_col)
    stats = df.agg(F.avg(x).alias("_sa_m"), F.stddev_pop(x).alias("_sa_s"))
    div = F.coalesce(F.when(F.col("_sa_s") != 0, F.col("_sa_s")), F.lit(1.0))
    return (df.crossJoin(F.broadcast(stats))
            .withColumn(name, (x - F.col("_sa_m")) / div).drop("_sa_m", "_sa_s"))


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PRJ-13: drop, missing names ignored."""
    return df.drop(*cols)


def align_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """PRJ-14: the training feature list in order; missing ones are 0."""
    have = set(df.columns)
    return df.select(*[F.col(k) for k in keep],
                     *[F.col(c) if c in have else F.lit(0).alias(c) for c in features])


@dataclass
class FeatureState:
    """What ``prepare_features`` learns on its first call and reuses later."""
    target: str | None = None
    encoders: dict = field(default_factory=dict)
    scaler: dict = field(default_factory=dict)
    feature_columns: list = field(default_factory=list)


def prepare_features(df: DataFrame, state: FeatureState, target_col: str | None = None,
                     keep: Sequence[str] = (), fit: bool | None = None) -> DataFrame:
    """The model input: target split off, timestamps expanded, strings label
    coded (unseen -> -1), remaining nulls 0, numbers only, standard scaled.
    Columns in ``keep`` (e.g. a row id) are carried along unscaled under a
    ``__`` prefix.  ``fit`` defaults to "not fitted yet"."""
    fit = (not state.feature_columns) if fit is None else fit
    target = target_col if target_col is not None else label_column(df)
    carried = [F.col(k).alias(f"__{k}") for k in keep]
    y = [F.col(target).alias("__label")] if target and target in df.columns else []
    X = df.select(*carried, *y, *[F.col(c) for c in df.columns if c != target])
    X = timestamp_expand(X, [c for c in temporal_columns(X) if not c.startswith("__")])
    strings = [c for c in string_columns(X) if not c.startswith("__")]
    if fit:
        state.target = target
        state.encoders = fit_label_encoders(X, strings)
    X = apply_label_encoders(X, {c: e for c, e in state.encoders.items() if c in strings})
    nums = [c for c in numeric_columns(X) if not c.startswith("__")]
    X = X.na.fill(0, subset=nums)
    if fit:
        state.scaler = fit_scaler(X, nums)
        state.feature_columns = nums
    # aligned last: a column that is missing at scoring is 0 after the scaling
    X = apply_scaler(X, state.scaler)
    return align_features(X, state.feature_columns, keep=[c for c in X.columns if c.startswith("__")])
