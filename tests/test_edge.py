"""Edge tables (FIXTURES D): empty, one row, zero variance, all-null column,
tied mode, tied peak day, probability 0 / 0.3 / 0.7, unseen category,
+-infinity and NaN, few minority rows."""
import math

from pyspark.sql import functions as F

from ledgerlens.operators import anomaly as A
from ledgerlens.operators import clean as K
from ledgerlens.operators import features as FE
from ledgerlens.operators import metrics as M
from ledgerlens.operators import report as R
from ledgerlens.operators import stats as S
from ledgerlens.operators.smote import smote

SCHEMA = "transaction_id bigint, customer_id bigint, amount double, category string, transaction_date timestamp_ntz"


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert A.zscore_outliers(df).count() == 0
    assert A.frequency_outliers(df).count() == 0
    assert K.clean(df).count() == 0
    st = S.dataset_stats(df, A.anomaly_records(df)).first()
    assert st["total_transactions"] == 0 and st["anomaly_rate"] == 0.0
    assert "Total Transactions: 0" in R.text_report(df).first()["report"]


def test_one_row_and_zero_variance(spark):
    one = spark.createDataFrame([(1, 1, 5.0, "a", None)], SCHEMA)
    assert A.zscore_outliers(one).count() == 0
    flat = spark.createDataFrame([(i, i, 7.0, "a", None) for i in range(10)], SCHEMA)
    assert A.zscore_outliers(flat).count() == 0
    scaled = FE.standard_scale(flat, ["amount"]).agg(F.max(F.abs("amount"))).first()[0]
    assert scaled == 0.0


def test_all_null_and_tied_mode(spark):
    rows = [(1, None, None, "b", None), (2, None, None, "a", None), (3, None, None, None, None),
            (4, None, None, "b", None), (5, None, None, "a", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = K.impute_mode(K.impute_median(df))
    assert out.where(F.col("amount").isNotNull()).count() == 0          # all-null stays null
    assert out.where("transaction_id = 3").first()["category"] == "a"   # tie -> smallest
    none = spark.createDataFrame([(1, 1, 1.0, None, None)], SCHEMA)
    assert K.impute_mode(none).first()["category"] == "Unknown"


def test_tied_peak_day(spark):
    rows = [(1, 1, 10.0, "a", "2024-01-02 10:00:00"), (2, 1, 10.0, "a", "2024-01-01 09:00:00"),
            (3, 1, 5.0, "a", "2024-01-03 09:00:00")]
    df = spark.createDataFrame(rows, "transaction_id bigint, customer_id bigint, amount double, category string, t string") \
        .select("transaction_id", "customer_id", "amount", "category",
                F.to_timestamp("t").alias("transaction_date"))
    assert S.daily_peak(df).first()["peak_day"] == "2024-01-01"


def test_band_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (0.7,), (0.30001,), (1.0,)], "p double")
    got = [r[0] for r in df.select(M.risk_band("p")).collect()]
    assert got == [None, "Low", "Medium", "Medium", "High"]
    s = R.risk_summary(df.withColumnRenamed("p", "fraud_probability")).first()
    assert (s["high_risk_transactions"], s["medium_risk_transactions"], s["low_risk_transactions"]) == (1, 2, 2)


def test_unseen_category_code(spark):
    fit = spark.createDataFrame([("x",), ("y",)], "category string")
    enc = FE.fit_label_encoders(fit, ["category"])
    new = spark.createDataFrame([("y",), ("z",), (None,)], "category string")
    codes = sorted(r[0] for r in FE.apply_label_encoders(new, enc).collect())
    assert codes == [-1, -1, 1]


def test_infinity_and_nan(spark):
    df = spark.createDataFrame([(1, "inf"), (2, "-inf"), (3, "NaN"), (4, "2.5"), (5, "x")], "id bigint, amount string")
    out = K.drop_infinity(K.coerce_numeric(df, "amount"))
    vals = {r["id"]: r["amount"] for r in out.collect()}
    assert vals[4] == 2.5 and all(vals[i] is None for i in (1, 2, 3, 5))
    filled, n, med = K.impute_amount(out, "amount")
    assert n == 4 and med == 2.5


def test_few_minority_rows(spark):
    rows = [(i, float(i), float(i % 3), 1 if i < 3 else 0) for i in range(20)]
    df = spark.createDataFrame(rows, "__row_id bigint, a double, b double, __label int")
    syn = smote(df, ["a", "b"], label="__label", id_col="__row_id")
    assert syn.count() == 17 - 3
    # synthetic points lie on segments between minority points (a in [0, 2])
    lo, hi = syn.agg(F.min("a"), F.max("a")).first()
    assert 0.0 <= lo and hi <= 2.0
    one = df.where("__row_id <> 1 AND __row_id <> 2")
    assert smote(one, ["a", "b"], label="__label", id_col="__row_id").count() == 0


def test_nan_is_missing_for_median(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "x double")
    out = K.impute_median(df)
    assert sorted(r[0] for r in out.collect()) == [1.0, 2.0, 2.0, 3.0]
    assert not any(math.isnan(r[0]) for r in out.collect())
