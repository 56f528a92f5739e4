"""Model bundle save / load (SNK-2, SNK-3): fraud model, anomaly model,
scaler, label dictionaries and feature names, each written only if present
and each optional on load.  Everything is written with Spark writers to the
given (shared) path: the forest as an MLlib ``PipelineModel``, dictionaries
and the isolation-forest node table as parquet, the small metadata as a
one-row parquet."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import SparkSession

from ..session import path_exists
from .features import FeatureState
from .fraud import FraudModel, load_fraud_model, save_fraud_model
from .iforest import IForestModel


@dataclass
class ModelBundle:
    fraud: FraudModel | None = None
    iforest: IForestModel | None = None
    iforest_state: FeatureState | None = None


def save_models(bundle: ModelBundle, path: str) -> str:
    spark = SparkSession.getActiveSession()
    if bundle.fraud is not None:
        save_fraud_model(bundle.fraud, f"{path}/fraud")
    if bundle.iforest is not None:
        m = bundle.iforest
        spark.createDataFrame(m.nodes).write.mode("overwrite").parquet(f"{path}/anomaly_model/nodes")
        meta = {"features": m.features, "psi": m.psi, "offset": m.offset, "contamination": m.contamination}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite") \
            .parquet(f"{path}/anomaly_model/meta")
        if bundle.iforest_state is not None:
            save_fraud_model(FraudModel(state=bundle.iforest_state), f"{path}/anomaly_features")
    return path


def load_models(spark: SparkSession, path: str) -> ModelBundle:
    out = ModelBundle()
    if path_exists(spark, f"{path}/fraud/meta"):
        out.fraud = load_fraud_model(spark, f"{path}/fraud")
    if path_exists(spark, f"{path}/anomaly_model/meta"):
        meta = json.loads(spark.read.parquet(f"{path}/anomaly_model/meta").first()["meta"])
        nodes: pd.DataFrame = spark.read.parquet(f"{path}/anomaly_model/nodes").toPandas()  # trees*(2psi-1) rows
        out.iforest = IForestModel(features=meta["features"], nodes=nodes, psi=meta["psi"],
                                   offset=meta["offset"], contamination=meta["contamination"])
    if path_exists(spark, f"{path}/anomaly_features/meta"):
        out.iforest_state = load_fraud_model(spark, f"{path}/anomaly_features").state
    return out


__all__ = ["ModelBundle", "save_models", "load_models"]
