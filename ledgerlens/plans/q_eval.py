"""Registered model-evaluation queries on the deterministic score
(MLS-2, 3, 5, 7..10, 13): all exact, all with a DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import r6
from ..operators import metrics as M
from ..operators import sampling as SP
from ..sources.views import SQL_SCORED, SQL_TXN, scored, txn
from .catalog import register


@register("stratified_split", f"""WITH {SQL_TXN}
SELECT transaction_id, is_fraud,
       CASE WHEN row_number() OVER (PARTITION BY is_fraud ORDER BY substr(md5(cast(transaction_id AS varchar) || ':42'), 1, 13))
                 <= floor(0.2 * count(*) OVER (PARTITION BY is_fraud) + 0.5) THEN 'test' ELSE 'train' END AS split FROM txn""")
def q_stratified_split(spark, sf_dir):
    t = txn(spark, sf_dir)
    return t.select("transaction_id", "is_fraud",
                    F.when(SP.held_out(t, "is_fraud", "transaction_id"), "test").otherwise("train").alias("split"))


@register("class_balance", f"""WITH {SQL_TXN}
SELECT round(avg(is_fraud), 6) AS fraud_rate, avg(is_fraud) < 0.1 AS apply_smote FROM txn""")
def q_class_balance(spark, sf_dir):
    b = SP.class_balance(txn(spark, sf_dir), "is_fraud")
    return b.select(r6(F.col("fraud_rate")).alias("fraud_rate"), "apply_smote")


@register("class_weights", f"""WITH {SQL_TXN},
c AS (SELECT is_fraud AS label, count(*) AS n_c FROM txn GROUP BY 1)
SELECT label, round((SELECT sum(n_c) FROM c) / ((SELECT count(*) FROM c) * n_c), 6) AS weight FROM c""")
def q_class_weights(spark, sf_dir):
    return SP.class_weights(txn(spark, sf_dir), "is_fraud").withColumn("weight", r6(F.col("weight")))


@register("confusion_matrix", f"""WITH {SQL_SCORED},
l AS (SELECT is_fraud AS label FROM scored UNION SELECT fraud_prediction FROM scored),
p AS (SELECT is_fraud AS actual, fraud_prediction AS predicted, count(*) AS n FROM scored GROUP BY 1, 2)
SELECT a.label AS actual, b.label AS predicted, coalesce(n, 0) AS count
FROM l a CROSS JOIN l b LEFT JOIN p ON p.actual = a.label AND p.predicted = b.label""")
def q_confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(scored(spark, sf_dir), "is_fraud", "fraud_prediction")


@register("accuracy", f"""WITH {SQL_SCORED}
SELECT round(avg(cast(is_fraud = fraud_prediction AS double)), 6) AS accuracy FROM scored""")
def q_accuracy(spark, sf_dir):
    return M.accuracy(scored(spark, sf_dir), "is_fraud", "fraud_prediction").select(
        r6(F.col("accuracy")).alias("accuracy"))


@register("classification_report", f"""WITH {SQL_SCORED},
l AS (SELECT is_fraud AS label FROM scored UNION SELECT fraud_prediction FROM scored),
per AS (SELECT l.label,
          count(*) FILTER (WHERE s.is_fraud = l.label AND s.fraud_prediction = l.label) AS tp,
          count(*) FILTER (WHERE s.is_fraud = l.label) AS support,
          count(*) FILTER (WHERE s.fraud_prediction = l.label) AS npred
        FROM l CROSS JOIN scored s GROUP BY l.label),
pr AS (SELECT label, coalesce(tp / nullif(npred, 0), 0.0) AS precision, coalesce(tp / nullif(support, 0), 0.0) AS recall,
              support, tp FROM per),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1_score FROM pr),
t AS (SELECT sum(support) AS total, sum(tp) AS correct, avg(precision) AS mp, avg(recall) AS mr, avg(f1_score) AS mf,
             sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1_score * support) AS wf FROM f)
SELECT cast(label AS varchar) AS label, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1_score, 6) AS f1_score, cast(support AS bigint) AS support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round(correct / total, 6), cast(total AS bigint) FROM t
UNION ALL SELECT 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), cast(total AS bigint) FROM t
UNION ALL SELECT 'weighted avg', round(wp / total, 6), round(wr / total, 6), round(wf / total, 6), cast(total AS bigint) FROM t""")
def q_classification_report(spark, sf_dir):
    r = M.classification_report(scored(spark, sf_dir), "is_fraud", "fraud_prediction")
    return r.select("label", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1_score")], "support")


@register("roc_auc", f"""WITH {SQL_SCORED},
g AS (SELECT fraud_probability AS s, count(*) FILTER (WHERE is_fraud = 1) AS pos,
             count(*) FILTER (WHERE is_fraud <> 1) AS neg FROM scored GROUP BY 1),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM g)
SELECT round(sum(pos * (nb + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM c""")
def q_roc_auc(spark, sf_dir):
    return M.roc_auc(scored(spark, sf_dir), "is_fraud", "fraud_probability").select(
        r6(F.col("roc_auc")).alias("roc_auc"))


@register("risk_bands", f"""WITH {SQL_SCORED}
SELECT transaction_id, round(fraud_probability, 6) AS fraud_probability,
       CASE WHEN fraud_probability > 0 AND fraud_probability <= 0.3 THEN 'Low'
            WHEN fraud_probability > 0.3 AND fraud_probability <= 0.7 THEN 'Medium'
            WHEN fraud_probability > 0.7 AND fraud_probability <= 1 THEN 'High' END AS risk_level
FROM scored""")
def q_risk_bands(spark, sf_dir):
    s = scored(spark, sf_dir)
    return s.select("transaction_id", r6(F.col("fraud_probability")).alias("fraud_probability"),
                    M.risk_band("fraud_probability").alias("risk_level"))
