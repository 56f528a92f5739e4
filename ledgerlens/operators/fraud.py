"""Supervised fraud model (MLS-1, MLS-6, MLS-11, MLS-12, MLS-14, MLS-15,
SNK-2, SNK-3).

Random forest from MLlib (distributed tree growing) with the reference's
settings; features from ``prepare_features`` fitted on the training part
only; SMOTE on the training part when the positive rate is under the gate;
balanced class weights; evaluation with the exact metric operators."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import training_label_column, with_row_id
from ..functions.partitioning import ensure_parallelism
from ..session import path_exists, stored
from .features import FeatureState, prepare_features
from .metrics import accuracy, classification_report, confusion_matrix, risk_band, roc_auc
from .sampling import stratified_split, with_class_weights
from .smote import smote


@dataclass
class FraudModel:
    state: FeatureState
    model: PipelineModel | None = None
    row_id: str = "transaction_id"
    metrics: dict = field(default_factory=dict)


def _assembled_pipeline(features: list[str], seed: int = C.SEED) -> Pipeline:
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    rf = RandomForestClassifier(labelCol="__label", featuresCol="features", weightCol="__weight",
                                numTrees=C.RF_TREES, maxDepth=C.RF_MAX_DEPTH, minInstancesPerNode=C.RF_MIN_LEAF,
                                featureSubsetStrategy="sqrt", seed=seed)
    return Pipeline(stages=[assembler, rf])


def train_fraud_model(df: DataFrame, target_col: str | None = None, row_id: str = "transaction_id",
                      seed: int = C.SEED) -> FraudModel:
    """MLS-6: train on 80 % of each class, evaluate on the other 20 %."""
    target = target_col or training_label_column(df)
    if target is None or target not in df.columns:
        raise ValueError(C.NO_TARGET_TEXT)
    # every step reads the raw columns from here: the split, the dictionaries, the scaler, both parts
    df = stored(with_row_id(df, row_id), "fraud-input")
    raw_train, raw_test = stratified_split(df, target, row_id, seed)
    state = FeatureState()
    train = prepare_features(raw_train, state, target, keep=[row_id], fit=True)
    test = prepare_features(raw_test, state, target, keep=[row_id], fit=False)
    feats = list(state.feature_columns)
    # SMOTE reads the training features several times (class counts, minority
    # matrix, generation joins): written once, read by column
    train = stored(train.withColumn("__label", F.col("__label").cast("double")), "fraud-train")
    rate = df.agg(F.avg(F.col(target).cast("double"))).first()[0] or 0.0
    if rate < C.SMOTE_GATE:
        synth = smote(train.select(f"__{row_id}", *feats, "__label"), feats, id_col=f"__{row_id}")
        train = train.select(*feats, "__label").unionByName(synth)
    train = with_class_weights(train.select(*feats, "__label"), "__label", "__weight")
    # the forest reads its input several times (split finding, bagging):
    # materialise it once, spread over the cluster, lineage cut
    train = stored(ensure_parallelism(train), "fraud-balanced")
    model = _assembled_pipeline(feats, seed).fit(train)
    fm = FraudModel(state=state, model=model, row_id=row_id)
    # only (label, prediction, probability) of the test part, written once and
    # read by the four metrics instead of re-running features + forest for each
    pred = _score(fm, test.withColumn("__label", F.col("__label").cast("double"))) \
        .select("__label", "fraud_prediction", "fraud_probability")
    pred = stored(pred, "fraud-test")
    fm.metrics = {
        "accuracy": accuracy(pred, "__label", "fraud_prediction"),
        "roc_auc": roc_auc(pred, "__label", "fraud_probability", positive=1.0),
        "classification_report": classification_report(pred, "__label", "fraud_prediction"),
        "confusion_matrix": confusion_matrix(pred, "__label", "fraud_prediction"),
        "feature_importance": feature_importance(fm, df.sparkSession),
    }
    return fm


def _score(fm: FraudModel, X: DataFrame) -> DataFrame:
    out = fm.model.transform(X)
    return out.withColumn("fraud_probability", vector_to_array("probability")[1]) \
        .withColumn("fraud_prediction", F.col("prediction").cast("int"))


def feature_importance(fm: FraudModel, spark: SparkSession) -> DataFrame:
    """MLS-11: importance per feature name (one row per feature)."""
    imp = fm.model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(fm.state.feature_columns, [float(x) for x in imp])),
                                 "feature string, importance double")


def predict_fraud(fm: FraudModel, df: DataFrame) -> DataFrame:
    """MLS-12/13: the input rows plus fraud_probability, fraud_prediction and
    risk_level.  Original columns ride along the feature plan (no join)."""
    if fm.model is None:
        raise ValueError(C.NOT_TRAINED_TEXT)
    target = fm.state.target
    keep = [c for c in df.columns]
    X = prepare_features(df, fm.state, target_col=target if target in df.columns else "",
                         keep=keep, fit=False)
    scored = _score(fm, X)
    back = [F.col(f"__{c}").alias(c) for c in keep]
    return scored.select(*back, "fraud_probability", "fraud_prediction",
                         risk_band("fraud_probability").alias("risk_level"))


# --- SNK-2 / SNK-3 ----------------------------------------------------------

def save_fraud_model(fm: FraudModel, path: str) -> str:
    spark = SparkSession.getActiveSession()
    if fm.model is not None:
        fm.model.write().overwrite().save(f"{path}/fraud_model")
    for c, (dic, _) in fm.state.encoders.items():
        dic.write.mode("overwrite").parquet(f"{path}/label_encoders/{c}")
    meta = {"target": fm.state.target, "features": fm.state.feature_columns, "row_id": fm.row_id,
            "scaler": fm.state.scaler, "encoders": list(fm.state.encoders)}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").parquet(f"{path}/meta")
    return path


def load_fraud_model(spark: SparkSession, path: str) -> FraudModel:
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    enc = {}
    for c in meta["encoders"]:
        dic = spark.read.parquet(f"{path}/label_encoders/{c}")
        enc[c] = (dic, dic.count())
    state = FeatureState(target=meta["target"], encoders=enc,
                         scaler={k: tuple(v) for k, v in meta["scaler"].items()},
                         feature_columns=meta["features"])
    # the bundle may hold only the unsupervised part; a part that is there must load
    model = PipelineModel.load(f"{path}/fraud_model") if path_exists(spark, f"{path}/fraud_model") else None
    return FraudModel(state=state, model=model, row_id=meta["row_id"])
