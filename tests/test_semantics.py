"""Missing values, row identity, splits and readers as pandas has them."""
import json
import math

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.partitioning import ensure_parallelism, estimated_splits
from ledgerlens.operators import anomaly as A
from ledgerlens.operators import bundle as B
from ledgerlens.operators import clean as K
from ledgerlens.operators import features as FE
from ledgerlens.operators import fraud as FR
from ledgerlens.operators import metrics as M
from ledgerlens.operators import report as R
from ledgerlens.operators import retrieval as RT
from ledgerlens.operators import sampling as SP
from ledgerlens.plans import flows as PL
from ledgerlens.session import scratch_path
from ledgerlens.sources import readers as RD
from ledgerlens.sources.sinks import write_csv
from ledgerlens.streaming.scoring import write_batch


def _amounts(spark, extra):
    rows = [(i, 10.0 + i % 3) for i in range(200)] + [(1000, extra)]
    return spark.createDataFrame(rows, "transaction_id bigint, amount double")


def test_nan_and_infinity_flag_nothing(spark):
    for v in (float("nan"), float("inf")):
        df = _amounts(spark, v)
        assert A.zscore_outliers(df).count() == 0
        assert A.flag_anomalies(df).where("is_anomaly").count() == 0
    assert [r["row_id"] for r in A.zscore_outliers(_amounts(spark, 500.0)).collect()] == [1000]


def test_risk_summary_ignores_nan(spark):
    df = spark.createDataFrame([(0.9,), (float("nan"),), (0.1,)], "fraud_probability double")
    r = R.risk_summary(df).first()
    assert (r["high_risk_transactions"], r["low_risk_transactions"]) == (1, 1)
    assert r["average_fraud_probability"] == pytest.approx(0.5)


def test_empty_text_is_a_mode(spark):
    df = spark.createDataFrame([("",), ("",), ("a",), (None,)], "v string")
    assert sorted(r[0] for r in K.impute_mode(df).collect()) == ["", "", "", "a"]


def test_one_class_has_no_roc(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.7)], "y int, p double")
    assert M.roc_auc(df, "y", "p").first()["roc_auc"] is None


def test_stratified_split_is_exact_per_class(spark):
    df = spark.range(1003).select(F.col("id").alias("transaction_id"), (F.col("id") % 100 < 3).cast("int").alias("y"))
    train, test = SP.stratified_split(df, "y", "transaction_id")
    n = {r["y"]: r["n"] for r in df.groupBy("y").agg(F.count("*").alias("n")).collect()}
    t = {r["y"]: r["n"] for r in test.groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert t == {c: math.floor(0.2 * k + 0.5) for c, k in n.items()}
    assert train.count() + test.count() == 1003 and train.join(test, "transaction_id").count() == 0


def test_training_with_three_positives(spark):
    df = spark.range(100).select(F.col("id").alias("transaction_id"), (F.col("id") % 7).cast("double").alias("amount"),
                                 (F.col("id") < 3).cast("int").alias("is_fraud"))
    fm = FR.train_fraud_model(df, "is_fraud")
    assert FR.predict_fraud(fm, df).count() == 100
    # a column that is missing at scoring is 0 after the scaling
    X = FE.prepare_features(df.drop("amount"), fm.state, "is_fraud", fit=False)
    assert X.select("amount").distinct().collect()[0][0] == 0.0


def test_csv_as_pandas_reads_it(spark):
    path = scratch_path(spark, "csv") + ".csv"
    rows = [(1, "NA", 'he said "hi", ok'), (2, "3.5", "two\nlines"), (3, "", "plain")]
    write_csv(spark.createDataFrame(rows, "id bigint, amount string, note string").coalesce(1), path)
    df = RD.load_transactions(spark, path)
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "double", "string"]
    got = {r["id"]: (r["amount"], r["note"]) for r in df.collect()}
    assert got == {1: (None, 'he said "hi", ok'), 2: (3.5, "two\nlines"), 3: (None, "plain")}


def test_json_array_and_corrupt_record(spark):
    path = scratch_path(spark, "json") + ".json"
    text = json.dumps([{"id": 1, "amount": 2.0}, {"id": 2, "amount": None}], indent=2)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    assert sorted((r["id"], r["amount"]) for r in RD.load_transactions(spark, path).collect()) == [(1, 2.0), (2, None)]
    bad = scratch_path(spark, "json") + ".json"
    spark.createDataFrame([('{"id": 1}',), ('{"id": ',)], "value string").coalesce(1).write.text(bad)
    with pytest.raises(Exception):
        RD.load_transactions(spark, bad).collect()


def _page_table(spark):
    rows = [(float(i), (i * 37 % 11) / 3.0, (i * 17 % 7) / 2.0, float(i % 50) + (900 if i == 77 else 0), int(i == 77)) for i in range(300)]
    return spark.createDataFrame(rows + rows[:3], "Time double, V1 double, V2 double, Amount double, Class int")


def test_runs_without_an_id_column(spark):
    page = PL.page_run(_page_table(spark))
    assert page.flagged.count() == 303 and page.alerts.count() in (3, 4)
    full = PL.full_run(_page_table(spark).drop("Class").withColumnRenamed("Amount", "amount"))
    assert full.predictions.count() == 300                        # equal rows are duplicates
    assert full.prompts.count() == 3


def test_runs_with_text_ids(spark):
    df = _page_table(spark).dropDuplicates().withColumn("transaction_id", F.concat(F.lit("t-"), F.col("Time").cast("string")))
    page = PL.page_run(df)
    assert page.alerts.where("transaction_id LIKE 't-%'").count() == page.alerts.count() > 0
    small = df.withColumnRenamed("Amount", "amount").drop("Class")
    assert A.anomaly_records(small).where("row_id = 't-77.0'").count() == 1
    assert RT.row_documents(small, "transaction_id").where("row_id LIKE 't-%'").count() == 300


def test_full_run_from_a_path_saves_its_models(spark):
    path = scratch_path(spark, "in") + ".csv"
    df = spark.range(120).select(F.col("id").alias("transaction_id"), (F.col("id") % 9).cast("double").alias("amount"),
                                 (F.col("id") % 10 == 0).cast("int").alias("is_fraud"))
    write_csv(df.coalesce(1), path)
    out = scratch_path(spark, "saved")
    r = PL.full_run(path, model_path=out, spark=spark, corpus_cap=10)
    assert r.predictions.count() == 120
    assert B.load_models(spark, out).fraud.model is not None


def test_bundle_parts_that_exist_must_load(spark):
    out = scratch_path(spark, "broken")
    spark.createDataFrame([("no json",)], "meta string").write.parquet(f"{out}/fraud/meta")
    with pytest.raises(Exception):
        B.load_models(spark, out)
    with pytest.raises(Exception):
        B.load_models(spark, "nofs://host/models")


def test_replayed_batch_replaces_itself(spark):
    path = scratch_path(spark, "stream")
    batch = spark.range(10)
    for _ in range(2):
        write_batch(batch, 0, path)
    write_batch(batch, 1, path)
    assert spark.read.parquet(path).count() == 20


def test_parallelism_guard_runs_no_job(spark):
    df = spark.range(1000, numPartitions=2).groupBy((F.col("id") % 5).alias("k")).count()
    sc = spark.sparkContext
    sc.setJobGroup("guard", "guard")
    try:
        ensure_parallelism(df.join(df, "k"))
        assert len(sc.statusTracker().getJobIdsForGroup("guard")) == 0
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert estimated_splits(spark.range(8)) >= 1


def test_chunks_skip_empty_texts_and_bound_size(spark):
    df = spark.createDataFrame([(1, ""), (2, "x" * 2500), (3, None)], "id bigint, t string")
    assert RT.chunk_fixed(df, "id", "t").where("id <> 2").count() == 0
    text = " ".join(f"word{i}." for i in range(900)) + "\n\n" + "".join(chr(0x4E00 + i) for i in range(3000))
    parts = RT.split_recursive(text, 200, 40)
    assert all(0 < len(p) <= 200 for p in parts)
    at = 0
    for p in parts:                                               # chunks come in order and leave nothing out
        i = text.find(p)
        assert i >= 0 and (i <= at or text[at:i].strip() == "")
        at = i + len(p)
    assert text[at:].strip() == ""
