"""The reference's own assertions, on the same input shapes (FIXTURES A1-A3),
generated deterministically in Spark."""
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import anomaly as A
from ledgerlens.operators import clean as K
from ledgerlens.operators import features as FE
from ledgerlens.operators import fraud as FR
from ledgerlens.operators import iforest as IF
from ledgerlens.operators import report as R
from ledgerlens.operators import stats as S
from ledgerlens.functions.exprs import md5_unit
from ledgerlens.session import scratch_path
from ledgerlens.sources import readers as RD
from ledgerlens.sources.sinks import write_csv


def a1(spark, n=100):
    """FIXTURES A1: transaction_id, customer_id 1..19, amount exp(50), merchant, is_fraud."""
    keys = spark.range(n).withColumnRenamed("id", "k")
    s = RD.synthetic_transactions(keys, "k", seed=7)
    return s


def a2(spark, n=1000):
    """FIXTURES A2: amount exp(100), merchant_id, hour, day_of_week, is_fraud."""
    k = F.col("id")
    return spark.range(n).select(
        k.alias("transaction_id"), (-100 * F.log(1 - md5_unit(k, seed="a"))).alias("amount"),
        (F.floor(md5_unit(k, seed="m") * 99) + 1).cast("bigint").alias("merchant_id"),
        F.floor(md5_unit(k, seed="h") * 24).cast("bigint").alias("hour"),
        F.floor(md5_unit(k, seed="d") * 7).cast("bigint").alias("day_of_week"),
        (md5_unit(k, seed="f") < 0.05).cast("int").alias("is_fraud"))


def test_load_keeps_rows_and_columns(spark):
    df = a1(spark)
    path = scratch_path(spark, "a1") + ".csv"
    write_csv(df, path)
    back = RD.load_transactions(spark, path, df.schema)
    assert back.count() == 100
    assert back.columns == df.columns


def test_clean_removes_duplicates_and_nulls(spark):
    df = a1(spark)
    damaged = df.withColumn("amount", F.when(F.col("transaction_id") == 0, None).otherwise(F.col("amount")))
    damaged = damaged.unionByName(damaged.where(F.col("transaction_id") < 5))
    out = K.clean(damaged)
    assert out.count() == 100
    assert sum(K.null_counts(out).values()) == 0


def test_anomaly_flag_column_exists(spark):
    out = A.flag_anomalies(a1(spark))
    assert "is_anomaly" in out.columns
    assert out.count() == 100


def test_features_do_not_shrink(spark):
    df = a1(spark)
    out = FE.one_hot(FE.calendar_features(df))
    assert len(out.columns) >= len(df.columns)


def test_statistics_keys(spark):
    df = a1(spark)
    s = S.dataset_stats(df, A.anomaly_records(df, "transaction_id"))
    assert {"total_transactions", "total_anomalies", "anomaly_rate", "columns"} <= set(s.columns)
    f = S.fraud_stats(df).first()
    assert 0.0 <= f["fraud_rate"] <= 1.0


def test_error_texts(spark):
    df = a1(spark).drop("is_fraud")
    with pytest.raises(ValueError, match="No target column found"):
        FR.train_fraud_model(df, None)
    with pytest.raises(ValueError, match="Fraud model not trained"):
        FR.predict_fraud(FR.FraudModel(state=FE.FeatureState()), df)
    with pytest.raises(ValueError, match="Unsupported file format"):
        RD.load_transactions(spark, "/nowhere/file.xlsx")
    with pytest.raises(ValueError, match="No amount column found"):
        K.page_load(df.drop("amount"))


@pytest.fixture(scope="module")
def trained(spark):
    df = a2(spark)
    return df, FR.train_fraud_model(df, "is_fraud")


def test_auc_in_range(trained):
    _, fm = trained
    auc = fm.metrics["roc_auc"].first()["roc_auc"]
    assert 0.0 <= auc <= 1.0


def test_predictions(trained):
    df, fm = trained
    p = FR.predict_fraud(fm, df)
    assert {"fraud_probability", "fraud_prediction", "risk_level"} <= set(p.columns)
    lo, hi = p.agg(F.min("fraud_probability"), F.max("fraud_probability")).first()
    assert 0.0 <= lo <= hi <= 1.0
    summ = R.risk_summary(p)
    assert {"high_risk_transactions", "medium_risk_transactions", "low_risk_transactions",
            "average_fraud_probability", "total_amount_at_risk"} <= set(summ.columns)


def test_save_and_load(spark, trained):
    df, fm = trained
    path = scratch_path(spark, "bundle")
    FR.save_fraud_model(fm, path)
    back = FR.load_fraud_model(spark, path)
    a = FR.predict_fraud(fm, df).select("transaction_id", F.col("fraud_probability").alias("a"))
    b = FR.predict_fraud(back, df).select("transaction_id", F.col("fraud_probability").alias("b"))
    assert a.join(b, "transaction_id").where(F.col("a") != F.col("b")).count() == 0
    assert back.state.feature_columns == fm.state.feature_columns


def test_anomaly_model_rate(spark):
    df = a2(spark)
    st = FE.FeatureState()
    X = FE.prepare_features(df, st, None, keep=["transaction_id"], fit=True)
    m = IF.train_iforest(X, st.feature_columns, "__transaction_id", contamination=0.1)
    met = IF.training_metrics(m, X, "__transaction_id").first()
    assert met["total_samples"] == 1000
    assert 0.0 <= met["anomaly_rate"] <= 1.0
    assert abs(met["anomaly_rate"] - 0.1) <= 0.002


def test_bundle_parts_optional(spark, trained):
    from ledgerlens.operators.bundle import ModelBundle, load_models, save_models
    df, fm = trained
    path = scratch_path(spark, "bundle_parts")
    save_models(ModelBundle(fraud=fm), path)
    back = load_models(spark, path)
    assert back.fraud is not None and back.iforest is None
    st = FE.FeatureState()
    X = FE.prepare_features(df, st, None, keep=["transaction_id"], fit=True)
    m = IF.train_iforest(X, st.feature_columns, "__transaction_id")
    path2 = scratch_path(spark, "bundle_iforest")
    save_models(ModelBundle(iforest=m, iforest_state=st), path2)
    back2 = load_models(spark, path2)
    assert back2.fraud is None and back2.iforest.offset == m.offset
    assert back2.iforest_state.feature_columns == st.feature_columns
