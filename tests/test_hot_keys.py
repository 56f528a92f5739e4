"""A key that owns a third of the rows: joins broadcast the small side or split the key."""
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import anomaly as A
from ledgerlens.operators import smote
from ledgerlens.session import stored

LOW = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
       "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
       "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def no_broadcast(spark):
    before = {k: spark.conf.get(k, None) for k in LOW}
    for k, v in LOW.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def hot(spark):
    """Many files, so that the hot key's rows come from many map tasks."""
    i = F.col("id")
    df = spark.range(0, 60_000, 1, 24).select(
        i.alias("transaction_id"), F.when(i % 3 == 0, F.lit(7)).otherwise(i % 5000 + 10).cast("long").alias("customer_id"),
        (i % 97).cast("double").alias("amount"), F.md5(i.cast("string")).alias("note"))
    return stored(df, "hot")


@pytest.mark.parametrize("op", [A.flag_anomalies, A.frequency_rows])
def test_a_hot_customer_is_split_or_its_set_broadcast(spark, hot, no_broadcast, op):
    out = op(hot, "transaction_id")
    assert "skew=true" in final_plan(out)


def test_a_small_set_is_broadcast(spark, hot):
    plan = final_plan(A.flag_anomalies(hot, "transaction_id"))
    assert re.search(r"BroadcastHashJoin .*customer_id", plan) and "SortMergeJoin" not in plan


def test_hot_vectors_join_without_an_aggregate_beside_them(spark, no_broadcast):
    pts = stored(spark.range(0, 30_000, 1, 24).select("id", F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(
        F.array((F.col("id") % 9000).cast("double"), F.lit(5.0))).alias("v")), "points")
    assert "skew=true" in final_plan(smote.knn(pts, "id", "v", 3, local_limit=100_000).where("dist = 0"))
