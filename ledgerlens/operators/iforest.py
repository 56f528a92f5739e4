"""Isolation forest (MLU-1..5); MLlib has none.

Training: a row-level hash filter keeps a pool of about 2 * psi * trees rows
(psi = min(256, n)), each tree takes the psi pool rows with the smallest
hash of (row, tree), and ``groupBy(tree).applyInPandas`` grows one tree per
group of at most psi rows (Liu, Ting, Zhou 2008: random feature, uniform
split, height limit ceil(log2 psi)).  No step sees more than the pool, so
training cost does not grow with the table beyond one filtered scan.

Scoring: the node table (trees * (2 psi - 1) rows at most, a fixed bound) becomes
an MLlib forest (``forest``), which walks the trees on the JVM.  score = -2^(-E[h] / c(psi)), lower is more anomalous; the
threshold is the exact ``contamination`` quantile of the training scores."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.partitioning import ensure_parallelism
from ..session import ensure_checkpoint_dir
from ..functions.quantiles import exact_quantiles
from .forest import regression_forest

EULER = 0.5772156649
NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, "
               "size long, depth int, leaf boolean")


def _unit(rid, tree, seed: int):
    """Uniform [0, 1) from a 64-bit hash of (row, tree, seed)."""
    return F.shiftrightunsigned(F.xxhash64(rid, tree, F.lit(seed)), 11) / F.lit(float(1 << 53))


def c_factor(n) -> np.ndarray:
    """Average path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=np.float64)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _grow(tree: int, X: np.ndarray, seed: int, max_depth: int) -> list[tuple]:
    rng = np.random.default_rng([seed, tree])
    nodes: list[list] = []

    def build(idx: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([tree, me, -1, 0.0, -1, -1, len(idx), depth, True])
        if depth >= max_depth or len(idx) <= 1:
            return me
        sub = X[idx]
        lo, hi = sub.min(0), sub.max(0)
        usable = np.flatnonzero(hi > lo)
        if len(usable) == 0:
            return me
        f = int(rng.choice(usable))
        t = float(rng.uniform(lo[f], hi[f]))
        left = idx[sub[:, f] < t]
        right = idx[sub[:, f] >= t]
        nodes[me][2], nodes[me][3], nodes[me][8] = f, t, False
        nodes[me][4] = build(left, depth + 1)
        nodes[me][5] = build(right, depth + 1)
        return me

    build(np.arange(len(X)), 0)
    return [tuple(n) for n in nodes]


@dataclass
class IForestModel:
    features: list
    nodes: pd.DataFrame
    psi: int
    offset: float | None = None
    contamination: float = C.IFOREST_CONTAMINATION_AGENT
    train_scores: DataFrame | None = None      # checkpointed scores of the training frame
    train_frame: DataFrame | None = None
    forest: RandomForestRegressionModel | None = None   # the nodes as an MLlib model, made when first needed


def train_iforest(X: DataFrame, features: list[str], row_id: str, n_trees: int = C.IFOREST_TREES,
                  subsample: int = C.IFOREST_SUBSAMPLE, contamination: float = C.IFOREST_CONTAMINATION_AGENT,
                  seed: int = C.SEED) -> IForestModel:
    """MLU-1 (+ the MLU-3 offset from the training scores)."""
    ensure_checkpoint_dir(X.sparkSession)
    n = X.count()
    psi = max(1, min(subsample, n))
    max_depth = int(math.ceil(math.log2(psi))) if psi > 1 else 0
    rate = min(1.0, 2.0 * psi * n_trees / max(n, 1))
    pool = X.where(_unit(F.col(row_id), F.lit(-1), seed) < F.lit(rate)) if rate < 1.0 else X
    pool = pool.select(F.col(row_id).alias("_rid"),
                       F.array(*[F.col(c).cast("double") for c in features]).alias("_x")) \
        .checkpoint(eager=True)   # ~2 psi trees rows: one scan of X, reused below
    pool_n = pool.count()

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        mat = np.array(pdf["_x"].tolist(), dtype=np.float64).reshape(len(pdf), -1)
        return pd.DataFrame(_grow(t, mat, seed, max_depth),
                            columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth", "leaf"])

    # per tree, a hash threshold keeps ~2 psi candidates before any sort; only
    # (tree, id, hash) is sorted, features are joined back for the picked rows
    for factor in (2.0, None):
        q = min(1.0, factor * psi / max(pool_n, 1)) if factor else 1.0
        cand = pool.select("_rid", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree")) \
            .withColumn("_h", _unit(F.col("_rid"), F.col("tree"), seed))
        if q < 1.0:
            cand = cand.where(F.col("_h") < F.lit(q))
        w = Window.partitionBy("tree").orderBy("_h", "_rid")
        ids = cand.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= psi).select("tree", "_rid")
        picked = ids.join(pool, "_rid").select("tree", "_x")
        nodes = picked.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()   # <= trees * (2 psi - 1) rows
        roots = nodes[nodes["node"] == 0]
        if len(roots) == n_trees and (roots["size"] >= psi).all():
            break
    model = IForestModel(features=list(features), nodes=nodes, psi=psi, contamination=contamination)
    scores = score_samples(model, X, row_id).checkpoint(eager=True)   # one scoring pass, reused
    model.offset = exact_quantiles(scores, [("score", contamination)])[("score", contamination)]
    model.train_scores, model.train_frame = scores, X
    return model


def walk(model: IForestModel, rows: np.ndarray) -> np.ndarray:
    """Scores of a few rows by numpy, all trees level by level: what the JVM's walk is compared with."""
    nodes = model.nodes.sort_values(["tree", "node"])
    total = np.zeros(len(rows))
    for _, t in nodes.groupby("tree"):
        feature, threshold, left, right = (t[c].to_numpy() for c in ("feature", "threshold", "left", "right"))
        feature = np.where(t["leaf"], -1, feature)
        at = np.zeros(len(rows), np.int64)
        while (open_ := feature[at] >= 0).any():
            x = rows[np.arange(len(rows)), np.maximum(feature[at], 0)]
            at = np.where(open_, np.where(x < threshold[at], left[at], right[at]), at)
        total += _path_lengths(t)[at]
    return -np.power(2.0, -(total / nodes["tree"].nunique()) / _scale(model))


def _path_lengths(nodes: pd.DataFrame) -> np.ndarray:
    return nodes["depth"].to_numpy() + c_factor(nodes["size"].to_numpy())


def _scale(model: IForestModel) -> float:
    return float(c_factor(np.array([model.psi]))[0]) or 1.0


def native_forest(model: IForestModel, spark) -> RandomForestRegressionModel:
    """The trees as an MLlib forest whose predictions are mean path lengths."""
    if model.forest is None:
        model.forest = regression_forest(spark, model.nodes.assign(value=_path_lengths(model.nodes)), len(model.features))
    return model.forest


def add_score(model: IForestModel, X: DataFrame, name: str = "score") -> DataFrame:
    """MLU-2 as a column, ``-2^(-mean path / c(psi))``: the trees are walked on the
    JVM, on batches and on streams.  Missing features go right, as NaN does."""
    taken = VectorAssembler(inputCols=model.features, outputCol="__features", handleInvalid="keep").transform(X)
    forest = native_forest(model, X.sparkSession).copy().setFeaturesCol("__features").setPredictionCol("__path")
    score = -F.pow(F.lit(2.0), -F.col("__path") / F.lit(_scale(model)))
    return forest.transform(taken).withColumn(name, score).drop("__features", "__path")


def score_samples(model: IForestModel, X: DataFrame, row_id: str) -> DataFrame:
    """MLU-2: (row id, score)."""
    src = ensure_parallelism(X.select(F.col(row_id).alias("__rid"), *model.features))
    return add_score(model, src).select(F.col("__rid").alias(row_id), "score")


def detect(model: IForestModel, X: DataFrame, row_id: str) -> DataFrame:
    """MLU-3/MLU-4: score, decision = score - offset, is_anomaly = decision < 0.
    On the training frame itself the checkpointed training scores are reused
    (no second scoring pass)."""
    if X is model.train_frame and model.train_scores is not None and row_id in model.train_scores.columns:
        s = model.train_scores
    else:
        s = score_samples(model, X, row_id)
    dec = F.col("score") - F.lit(model.offset)
    return s.select(row_id, F.col("score").alias("anomaly_score"), dec.alias("decision"),
                    (dec < 0).alias("is_anomaly"))


def training_metrics(model: IForestModel, X: DataFrame, row_id: str) -> DataFrame:
    """MLU-5: samples, anomalies, rate, mean score."""
    d = detect(model, X, row_id)
    return d.agg(F.count(F.lit(1)).alias("total_samples"),
                 F.count_if("is_anomaly").alias("anomalies_detected"),
                 F.avg(F.col("is_anomaly").cast("double")).alias("anomaly_rate"),
                 F.avg("anomaly_score").alias("mean_anomaly_score"))
