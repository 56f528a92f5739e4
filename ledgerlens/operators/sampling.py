"""Train/test split, class balance and class weights (MLS-2, MLS-3, MLS-5)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.exprs import md5_unit
from ..functions.quantiles import exact_quantiles


def split_flag(row_id: str, seed: int = C.SEED, test_fraction: float = C.TEST_FRACTION) -> F.Column:
    """Hash bucket per row, without regard to classes: the same row always
    lands on the same side (used where a plain fraction of the rows is wanted)."""
    return md5_unit(row_id, seed=seed) < F.lit(test_fraction)


def _draw(row_id: str, seed: int) -> F.Column:
    """52 random bits of a row (exact in a double)."""
    return F.conv(F.substring(F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f":{seed}"))), 1, 13), 16, 10).cast("bigint")


def held_out(df: DataFrame, y: str, row_id: str, seed: int = C.SEED, test_fraction: float = C.TEST_FRACTION) -> F.Column:
    """MLS-2: true for exactly ``floor(test_fraction * n + 1/2)`` rows of each
    class: those with the smallest draws.  The cut between the k-th and the
    next draw of a class comes from the exact quantile search, so no class is
    ever sorted in one task; the flag itself is a row-wise filter.  A null
    label is a class of its own."""
    label = F.coalesce(F.col(y).cast("string"), F.lit("\x00null"))
    counts = [(r["c"], r["n"]) for r in df.groupBy(label.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()]  # a row per class
    cuts = {c: (n, math.floor(test_fraction * n + 0.5)) for c, n in counts}
    draws = df.select(*[F.when(label == c, _draw(row_id, seed)).cast("double").alias(f"d{i}") for i, c in enumerate(cuts)])
    specs = {c: (f"d{i}", (k - 0.5) / (n - 1)) for i, (c, (n, k)) in enumerate(cuts.items()) if 0 < k < n}
    found = exact_quantiles(draws, list(specs.values()))
    flag = F.lit(False)
    for c, (n, k) in cuts.items():
        mine = label == c
        if k == n:
            flag = flag | mine
        elif k:
            flag = flag | (mine & (_draw(row_id, seed) < F.lit(found[specs[c]])))
    return flag


def stratified_split(df: DataFrame, y: str, row_id: str, seed: int = C.SEED,
                     test_fraction: float = C.TEST_FRACTION) -> tuple[DataFrame, DataFrame]:
    """MLS-2: (train, test), each class split alike."""
    flag = held_out(df, y, row_id, seed, test_fraction)
    return df.where(~flag), df.where(flag)


def class_balance(df: DataFrame, y: str, gate: float = C.SMOTE_GATE) -> DataFrame:
    """MLS-3: positive rate and whether it is under the oversampling gate."""
    return df.agg(F.avg(F.col(y).cast("double")).alias("fraud_rate")) \
        .withColumn("apply_smote", F.col("fraud_rate") < gate)


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """MLS-5: balanced weights n / (k * n_c) per class."""
    counts = df.groupBy(F.col(y).alias("label")).agg(F.count(F.lit(1)).alias("n_c"))
    tot = counts.agg(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k"))
    return counts.crossJoin(F.broadcast(tot)).select(
        "label", (F.col("n") / (F.col("k") * F.col("n_c"))).alias("weight"))


def with_class_weights(df: DataFrame, y: str, weight_col: str = "weight") -> DataFrame:
    """Attach the balanced weight of each row's class (class table is tiny)."""
    w = class_weights(df, y).withColumnRenamed("weight", weight_col)
    return df.join(F.broadcast(w), df[y] == w["label"], "left").drop("label")
