"""Registered model queries: the supervised forest (MLS-1, 6, 11, 12, 14),
SMOTE (MLS-4, exact: hash-driven draws and exact neighbours, with a DuckDB
twin), the isolation forest (MLU-*), model bundles (SNK-2/3) and the two
end-to-end flows.  Learned parameters have no SQL twin, so those are
rows-only checks backed by property tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import r6
from ..operators import fraud as FR
from ..operators import iforest as IF
from ..operators import report as R
from ..operators import sampling as SP
from ..operators.features import FeatureState, prepare_features
from ..operators.smote import smote as smote_rows
from ..session import scratch_path
from ..sources.views import SQL_TXN, sql_md5_unit, txn, txn_orders
from . import flows as PL
from .catalog import register
from .q_clean import txn_text


def _fraud(spark, sf_dir):
    return FR.train_fraud_model(txn(spark, sf_dir), "is_fraud")


@register("fraud_train")
def q_fraud_train(spark, sf_dir):
    fm = _fraud(spark, sf_dir)
    return fm.metrics["accuracy"].crossJoin(fm.metrics["roc_auc"]) \
        .withColumn("n_features", F.lit(len(fm.state.feature_columns)))


@register("fraud_report")
def q_fraud_report(spark, sf_dir):
    return _fraud(spark, sf_dir).metrics["classification_report"]


@register("fraud_importance")
def q_fraud_importance(spark, sf_dir):
    return _fraud(spark, sf_dir).metrics["feature_importance"]


@register("fraud_scores")
def q_fraud_scores(spark, sf_dir):
    t = txn(spark, sf_dir)
    p = FR.predict_fraud(FR.train_fraud_model(t, "is_fraud"), t)
    return p.select("transaction_id", "fraud_probability", "fraud_prediction", "risk_level")


@register("fraud_summary")
def q_fraud_summary(spark, sf_dir):
    t = txn(spark, sf_dir)
    return R.risk_summary(FR.predict_fraud(FR.train_fraud_model(t, "is_fraud"), t))


@register("model_roundtrip")
def q_model_roundtrip(spark, sf_dir):
    t = txn(spark, sf_dir)
    fm = FR.train_fraud_model(t, "is_fraud")
    path = scratch_path(spark, "models")
    FR.save_fraud_model(fm, path)
    back = FR.load_fraud_model(spark, path)
    a = FR.predict_fraud(fm, t).select("transaction_id", F.col("fraud_probability").alias("p_trained"))
    b = FR.predict_fraud(back, t).select("transaction_id", F.col("fraud_probability").alias("p_loaded"))
    return a.join(b, "transaction_id")


def _smote_sql() -> str:
    feats = ["transaction_id", "customer_id", "amount", "category", "transaction_date_hour",
             "transaction_date_day", "transaction_date_month", "transaction_date_dayofweek"]
    raw = ["cast(tr.transaction_id AS double)", "cast(tr.customer_id AS double)", "tr.amount",
           "cast(coalesce(codes.code, -1) AS double)", "cast(hour(tr.transaction_date) AS double)",
           "cast(day(tr.transaction_date) AS double)", "cast(month(tr.transaction_date) AS double)",
           "cast(isodow(tr.transaction_date) - 1 AS double)"]
    n = len(feats)
    fcols = ", ".join(f"{e} AS f{i}" for i, e in enumerate(raw))
    stats = ", ".join(f"avg(f{i}) AS m{i}, stddev_pop(f{i}) AS s{i}" for i in range(n))
    xcols = ", ".join(f"(f{i} - m{i}) / coalesce(nullif(s{i}, 0), 1) AS x{i}" for i in range(n))
    dist = " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(n))
    outs = ", ".join(f"round(b.x{i} + u * (c.x{i} - b.x{i}), 6) AS {f}" for i, f in enumerate(feats))
    return f"""WITH {SQL_TXN},
tr AS (SELECT * FROM txn WHERE NOT ({sql_md5_unit('transaction_id', '42')} < 0.2)),
codes AS (SELECT category AS value, dense_rank() OVER (ORDER BY category) - 1 AS code
          FROM (SELECT DISTINCT coalesce(category, 'nan') AS category FROM tr)),
f AS (SELECT tr.transaction_id AS rid, cast(tr.is_fraud AS double) AS lbl, {fcols}
      FROM tr LEFT JOIN codes ON coalesce(tr.category, 'nan') = codes.value),
st AS (SELECT {stats} FROM f),
x AS (SELECT rid, lbl, {xcols} FROM f, st),
mino AS (SELECT * FROM x WHERE lbl = 1),
cnt AS (SELECT count(*) FILTER (WHERE lbl = 1) AS n_min, count(*) FILTER (WHERE lbl <> 1) AS n_maj FROM x),
nn AS (SELECT qid, nid, rank FROM (
         SELECT a.rid AS qid, b.rid AS nid,
                row_number() OVER (PARTITION BY a.rid ORDER BY {dist}, b.rid) AS rank
         FROM mino a JOIN mino b ON a.rid <> b.rid) WHERE rank <= least(5, (SELECT n_min - 1 FROM cnt))),
dic AS (SELECT rid, row_number() OVER (ORDER BY rid) - 1 AS code FROM mino),
syn AS (SELECT unnest(range(0, n_maj - n_min)) AS syn, n_min FROM cnt),
gen AS (SELECT syn, cast(floor({sql_md5_unit('syn', '42:base')} * n_min) AS bigint) AS code,
               cast(floor({sql_md5_unit('syn', '42:nn')} * least(5, n_min - 1)) + 1 AS bigint) AS rank,
               {sql_md5_unit('syn', '42:step')} AS u FROM syn)
SELECT {outs}, 1 AS __label
FROM gen JOIN dic ON dic.code = gen.code JOIN nn ON nn.qid = dic.rid AND nn.rank = gen.rank
JOIN mino b ON b.rid = dic.rid JOIN mino c ON c.rid = nn.nid"""


@register("smote", _smote_sql())
def q_smote(spark, sf_dir):
    t = txn(spark, sf_dir)
    train = t.where(~SP.split_flag("transaction_id"))
    st = FeatureState()
    X = prepare_features(train, st, "is_fraud", keep=["transaction_id"], fit=True)
    out = smote_rows(X.select("__transaction_id", *st.feature_columns, "__label"), st.feature_columns,
                     id_col="__transaction_id")
    return out.select(*[r6(F.col(c)).alias(c) if c != "__label" else F.col(c) for c in out.columns])


def _iforest(spark, sf_dir, contamination=0.1):
    t = txn(spark, sf_dir)
    st = FeatureState()
    X = prepare_features(t, st, None, keep=["transaction_id"], fit=True)
    return IF.train_iforest(X, st.feature_columns, "__transaction_id", contamination=contamination), X


@register("iforest_train")
def q_iforest_train(spark, sf_dir):
    m, X = _iforest(spark, sf_dir)
    return spark.createDataFrame(m.nodes)


@register("iforest_metrics")
def q_iforest_metrics(spark, sf_dir):
    m, X = _iforest(spark, sf_dir)
    return IF.training_metrics(m, X, "__transaction_id")


@register("iforest_scores")
def q_iforest_scores(spark, sf_dir):
    m, X = _iforest(spark, sf_dir)
    return IF.score_samples(m, X, "__transaction_id").withColumnRenamed("__transaction_id", "transaction_id")


@register("iforest_decision")
def q_iforest_decision(spark, sf_dir):
    m, X = _iforest(spark, sf_dir, contamination=0.01)
    return IF.detect(m, X, "__transaction_id").withColumnRenamed("__transaction_id", "transaction_id")


@register("iforest_roundtrip")
def q_iforest_roundtrip(spark, sf_dir):
    from ..operators.bundle import ModelBundle, load_models, save_models
    t = txn(spark, sf_dir)
    st = FeatureState()
    X = prepare_features(t, st, None, keep=["transaction_id"], fit=True)
    m = IF.train_iforest(X, st.feature_columns, "__transaction_id")
    path = scratch_path(spark, "bundle")
    save_models(ModelBundle(iforest=m, iforest_state=st), path)
    back = load_models(spark, path)
    X2 = prepare_features(t, back.iforest_state, None, keep=["transaction_id"], fit=False)
    a = IF.detect(m, X, "__transaction_id").select(
        F.col("__transaction_id").alias("transaction_id"), F.col("anomaly_score").alias("score_trained"))
    b = IF.detect(back.iforest, X2, "__transaction_id").select(
        F.col("__transaction_id").alias("transaction_id"), F.col("anomaly_score").alias("score_loaded"),
        "is_anomaly")
    return a.join(b, "transaction_id")


# --- end-to-end flows ------------------------------------------------------

@register("flow_full_summary")
def q_flow_full_summary(spark, sf_dir):
    return PL.full_run(txn(spark, sf_dir)).summary


@register("flow_full_prompts")
def q_flow_full_prompts(spark, sf_dir):
    return PL.full_run(txn(spark, sf_dir)).prompts


@register("flow_unsupervised")
def q_flow_unsupervised(spark, sf_dir):
    return PL.full_run(txn_orders(spark, sf_dir)).risk


@register("flow_page_alerts")
def q_flow_page_alerts(spark, sf_dir):
    return PL.page_run(txn_text(spark, sf_dir)).alerts


@register("flow_page_report")
def q_flow_page_report(spark, sf_dir):
    return PL.page_run(txn_text(spark, sf_dir)).report
