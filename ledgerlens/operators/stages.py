"""Feature preparation and scoring as MLlib stages (FEA-4, FEA-5, SNK-2, SNK-3),
so that one ``PipelineModel`` holds dictionaries, scaler, forest and threshold
and is loaded by ``PipelineModel.load`` alone."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LIMITS
from .features import FeatureState, prepare_features
from .fraud import FraudModel
from .iforest import IForestModel, _scale, native_forest
from .metrics import risk_band


class _Target(Params):
    targetCol = Param(Params._dummy(), "targetCol", "label column, left out of the features; empty for none", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "vector of the features", TypeConverters.toString)


class FeaturePreparer(Estimator, _Target, DefaultParamsReadable, DefaultParamsWritable):
    """Fits label dictionaries (text -> code) and the scaler on a table; the model adds a feature vector."""

    @keyword_only
    def __init__(self, *, targetCol: str = "", outputCol: str = "features"):
        super().__init__()
        self._setDefault(targetCol="", outputCol="features")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "PreparedFeatures":
        state = FeatureState()
        prepare_features(dataset, state, self.getOrDefault("targetCol"), fit=True)
        return PreparedFeatures.of(state, self.getOrDefault("targetCol"), self.getOrDefault("outputCol"))


class PreparedFeatures(Model, _Target, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the vector of label codes (-1 for unseen texts) and numbers, scaled, to a table.

    The dictionaries are part of the stage, so each may hold at most
    ``LIMITS.dictionary_local`` values; larger ones stay in a ``ModelBundle``."""

    fitted = Param(Params._dummy(), "fitted", "features, scaler and dictionaries as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, targetCol: str = "", outputCol: str = "features", fitted: str = "{}"):
        super().__init__()
        self._setDefault(targetCol="", outputCol="features", fitted="{}")
        self._set(**self._input_kwargs)

    @classmethod
    def of(cls, state: FeatureState, target: str | None = None, output: str = "features") -> "PreparedFeatures":
        values = {}
        for c, (dic, _) in state.encoders.items():
            rows = dic.orderBy("code").limit(LIMITS.dictionary_local + 1).collect()
            if len(rows) > LIMITS.dictionary_local:
                raise ValueError(f"{c} has over {LIMITS.dictionary_local} values: save it in a model bundle")
            values[c] = [r["value"] for r in rows]
        text = json.dumps({"features": state.feature_columns, "scaler": state.scaler, "values": values})
        return cls(targetCol=(target if target is not None else state.target) or "", outputCol=output, fitted=text)

    def state(self, spark) -> FeatureState:
        d = json.loads(self.getOrDefault("fitted"))
        encoders = {c: (spark.createDataFrame(list(zip(v, range(len(v)))), "value string, code bigint"), len(v)) for c, v in d["values"].items()}
        return FeatureState(target=self.getOrDefault("targetCol") or None, encoders=encoders,
                            scaler={c: tuple(v) for c, v in d["scaler"].items()}, feature_columns=d["features"])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        state, target, output = self.state(dataset.sparkSession), self.getOrDefault("targetCol"), self.getOrDefault("outputCol")
        own = [c for c in dataset.columns if c != output]
        X = prepare_features(dataset, state, target if target in dataset.columns else "", keep=own, fit=False)
        X = VectorAssembler(inputCols=state.feature_columns, outputCol="__vector", handleInvalid="keep").transform(X)
        return X.select(*(F.col(f"__{c}").alias(c) for c in own), F.col("__vector").alias(output))


class IsolationScore(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """MLU-2..4 after a forest of path lengths: ``anomaly_score``, ``decision``, ``is_anomaly``."""

    scale = Param(Params._dummy(), "scale", "mean path length of a sample", TypeConverters.toFloat)
    offset = Param(Params._dummy(), "offset", "threshold of the score", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, scale: float = 1.0, offset: float = -0.5):
        super().__init__()
        self._setDefault(scale=1.0, offset=-0.5)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        score = -F.pow(F.lit(2.0), -F.col("prediction") / F.lit(self.getOrDefault("scale")))
        out = dataset.withColumn("anomaly_score", score).withColumn("decision", F.col("anomaly_score") - F.lit(self.getOrDefault("offset")))
        return out.withColumn("is_anomaly", F.col("decision") < 0).drop("prediction", "features")


class FraudScore(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """MLS-12, MLS-13 after a classifier: ``fraud_probability``, ``fraud_prediction``, ``risk_level``."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset.withColumn("fraud_probability", vector_to_array("probability")[1]).withColumn("fraud_prediction", F.col("prediction").cast("int"))
        return out.withColumn("risk_level", risk_band("fraud_probability")).drop("features", "rawPrediction", "probability", "prediction")


def anomaly_pipeline(model: IForestModel, state: FeatureState, spark) -> PipelineModel:
    """Raw table in, anomaly columns added."""
    return PipelineModel(stages=[PreparedFeatures.of(state), native_forest(model, spark), IsolationScore(scale=_scale(model), offset=float(model.offset))])


def fraud_pipeline(fm: FraudModel) -> PipelineModel:
    """Raw table in, fraud columns added."""
    return PipelineModel(stages=[PreparedFeatures.of(fm.state), fm.model.stages[-1], FraudScore()])
