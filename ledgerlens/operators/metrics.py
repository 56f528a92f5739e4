"""Classifier evaluation and risk bands (MLS-7..10, MLS-13).

All metrics derive from the tiny (label, prediction) count table, or, for
ROC AUC, from per-distinct-score positive/negative counts with prefix sums
that never put an unbounded set in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.indexing import prefix_sums


def _pair_counts(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("actual"), F.col(pred).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def _labels(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("actual").alias("label")).union(
        pairs.select(F.col("predicted").alias("label"))).distinct()


def confusion_matrix(df: DataFrame, y: str, pred: str) -> DataFrame:
    """MLS-7: (actual, predicted, count) for every pair of labels, zeros
    included.  The grid is an explode of the one-row list of labels; the result
    has as many rows as the matrix has cells."""
    pairs = _pair_counts(df, y, pred)
    labels = _labels(pairs)
    every = labels.agg(F.array_sort(F.collect_list("label")).alias("_all"))
    grid = labels.select(F.col("label").alias("actual")).crossJoin(F.broadcast(every)).select(
        "actual", F.explode("_all").alias("predicted"))
    return grid.join(pairs, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("count"))


def accuracy(df: DataFrame, y: str, pred: str) -> DataFrame:
    """MLS-8."""
    return df.agg(F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy"))


def classification_report(df: DataFrame, y: str, pred: str) -> DataFrame:
    """MLS-9: precision, recall, F1, support per class; accuracy; macro and
    weighted averages.  Undefined ratios are 0."""
    pairs = _pair_counts(df, y, pred)
    labels = _labels(pairs)
    tp = pairs.where(F.col("actual") == F.col("predicted")).select(F.col("actual").alias("label"),
                                                                   F.col("n").alias("tp"))
    sup = pairs.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("support"))
    prd = pairs.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("npred"))
    per = (labels.join(tp, "label", "left").join(sup, "label", "left").join(prd, "label", "left")
           .na.fill(0, ["tp", "support", "npred"]))
    p = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("npred")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    per = per.select(F.col("label").cast("string").alias("label"), p.alias("precision"), r.alias("recall"),
                     "support", "tp")
    per = per.withColumn("f1_score", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                                             F.col("precision") + F.col("recall")), F.lit(0.0)))
    tot = per.agg(F.sum("support").alias("total"), F.sum("tp").alias("correct"), F.count(F.lit(1)).alias("k"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
                  F.sum(F.col("precision") * F.col("support")).alias("wp"),
                  F.sum(F.col("recall") * F.col("support")).alias("wr"),
                  F.sum(F.col("f1_score") * F.col("support")).alias("wf"))
    acc = tot.select(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"),
                     F.coalesce(F.try_divide(F.col("correct").cast("double"), F.col("total")), F.lit(0.0))
                     .alias("f1_score"), F.col("total").cast("bigint").alias("support"))
    macro = tot.select(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"),
                       F.col("mr").alias("recall"), F.col("mf").alias("f1_score"),
                       F.col("total").cast("bigint").alias("support"))
    weighted = tot.select(F.lit("weighted avg").alias("label"),
                          *[F.coalesce(F.try_divide(F.col(a), F.col("total")), F.lit(0.0)).alias(b)
                            for a, b in (("wp", "precision"), ("wr", "recall"), ("wf", "f1_score"))],
                          F.col("total").cast("bigint").alias("support"))
    cls = per.select("label", "precision", "recall", "f1_score", F.col("support").cast("bigint").alias("support"))
    return cls.unionByName(acc).unionByName(macro).unionByName(weighted)


def roc_auc(df: DataFrame, y: str, score: str, positive=1) -> DataFrame:
    """MLS-10: area under the ROC curve, tied scores counting one half; null if
    a class is absent (the area is not defined)."""
    g = df.groupBy(F.col(score).alias("s")).agg(
        F.count_if(F.col(y) == F.lit(positive)).cast("double").alias("pos"),
        F.count_if(F.col(y) != F.lit(positive)).cast("double").alias("neg"))
    c = prefix_sums(g, "s", ["neg"])
    return c.agg(F.try_divide(F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)),
                              F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def risk_band(p) -> F.Column:
    """MLS-13: (0,0.3] Low, (0.3,0.7] Medium, (0.7,1] High; 0 and outside -> null."""
    p = F.col(p) if isinstance(p, str) else p
    return (F.when((p > 0) & (p <= C.RISK_LOW), "Low").when((p > C.RISK_LOW) & (p <= C.RISK_HIGH), "Medium")
            .when((p > C.RISK_HIGH) & (p <= 1.0), "High"))
