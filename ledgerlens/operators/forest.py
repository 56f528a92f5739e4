"""Forests of given nodes as MLlib models, so that they are walked on the JVM,
on batches and streams alike, and are saved and loaded like any MLlib model.

MLlib has no way to make a tree model from nodes but its documented storage
layout, so the nodes are written in it and read back as a model."""

from __future__ import annotations

import json
import math
import time

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import SparkSession

from ..session import scratch_path

_NODES = ("treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double, "
          "leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>")


def _metadata(spark: SparkSession, kind: str, uid: str, params: dict, **more) -> str:
    return json.dumps({"class": f"org.apache.spark.ml.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid,
                       "paramMap": params, "defaultParamMap": {}, **more})


def _write(spark: SparkSession, nodes: pd.DataFrame, n_features: int, classifier: bool, path: str) -> None:
    group, name = ("classification", "Classification") if classifier else ("regression", "Regression")
    trees = sorted(int(t) for t in nodes["tree"].unique())
    more = {"numFeatures": n_features, "numTrees": len(trees)} | ({"numClasses": 2} if classifier else {})
    params = {"impurity": "gini" if classifier else "variance", "numTrees": len(trees), "featuresCol": "features", "predictionCol": "prediction",
              "labelCol": "label", "seed": 0, "leafCol": ""} | ({"probabilityCol": "probability", "rawPredictionCol": "rawPrediction"} if classifier else {})
    meta = _metadata(spark, f"{group}.RandomForest{name}Model", "forest", params, **more)
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    own = {k: v for k, v in params.items() if k != "numTrees"}
    per_tree = [(i, _metadata(spark, f"{group}.DecisionTree{name}Model", f"tree_{t}", own, **({k: v for k, v in more.items() if k != "numTrees"})), 1.0) for i, t in enumerate(trees)]
    spark.createDataFrame(per_tree, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    place = {t: i for i, t in enumerate(trees)}
    rows = []
    for n in nodes.itertuples():
        leaf = bool(n.leaf)
        # MLlib goes left up to the threshold itself, these trees only below it
        split = (-1, [], -1) if leaf else (int(n.feature), [float(np.nextafter(n.threshold, -math.inf))], -1)
        stats = [float(x) for x in n.stats] if classifier else [float(n.size), 0.0, 0.0]
        rows.append((place[int(n.tree)], (int(n.node), float(n.value), float(getattr(n, "impurity", 0.0)), stats, int(n.size),
                                          -1.0 if leaf else float(getattr(n, "gain", 0.0)), -1 if leaf else int(n.left), -1 if leaf else int(n.right), split)))
    spark.createDataFrame(rows, _NODES).coalesce(1).write.parquet(f"{path}/data")


def regression_forest(spark: SparkSession, nodes: pd.DataFrame, n_features: int) -> RandomForestRegressionModel:
    """The forest whose leaves have ``value``; a row's prediction is the mean over the
    trees.  Columns of ``nodes``: tree, node (numbered from 0, parents first), feature,
    threshold (left is below it), left, right, size, leaf, value."""
    path = scratch_path(spark, "forest")
    _write(spark, nodes, n_features, False, path)
    return RandomForestRegressionModel.load(path)


def classification_forest(spark: SparkSession, nodes: pd.DataFrame, n_features: int) -> RandomForestClassificationModel:
    """The forest of two classes whose nodes have the class counts ``stats``, an
    ``impurity`` and a ``gain``; a row's probability is the mean share over the trees."""
    path = scratch_path(spark, "forest")
    _write(spark, nodes.assign(value=[float(np.argmax(s)) for s in nodes["stats"]]), n_features, True, path)
    return RandomForestClassificationModel.load(path)
