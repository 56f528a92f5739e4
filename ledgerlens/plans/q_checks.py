"""Exact checks of learned parts: what must hold whatever was learned, as
counts over the same tables in both engines, and an isolation forest of a fixed
node table that SQL walks too."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from .. import config as C
from ..functions.exprs import r6
from ..operators import fraud as FR
from ..operators import iforest as IF
from ..operators import metrics as M
from ..operators import stages as ST
from ..operators.features import FeatureState, prepare_features
from ..operators.forest import classification_forest
from ..session import scratch_path
from ..sources.views import SQL_TXN, SQL_TXN_ORDERS, read_table, txn, txn_orders
from . import flows as PL
from . import q_ml as ML
from .catalog import QUERIES, register


def _n(cond, name: str):
    return F.count_if(F.coalesce(cond, F.lit(True))).cast("bigint").alias(name)


@register("fraud_scores_check", f"""WITH {SQL_TXN}
SELECT count(*) AS n_rows, count(DISTINCT transaction_id) AS n_ids, 0 AS outside, 0 AS wrong_band, 0 AS wrong_prediction FROM txn""")
def q_fraud_scores_check(spark, sf_dir):
    """Every row scored once, in [0, 1], with the band and the prediction of its probability."""
    p = F.col("fraud_probability")
    s = QUERIES["fraud_scores"](spark, sf_dir)
    wrong = ~F.col("risk_level").eqNullSafe(M.risk_band("fraud_probability"))
    return s.agg(F.count("*").alias("n_rows"), F.countDistinct("transaction_id").alias("n_ids"),
                 _n((p < 0) | (p > 1) | F.isnan(p), "outside"), _n(wrong, "wrong_band"),
                 _n((p != 0.5) & (F.col("fraud_prediction") != (p > 0.5).cast("int")), "wrong_prediction"))


@register("fraud_summary_check", f"WITH {SQL_TXN}\nSELECT count(*) AS banded, true AS mean_in_range FROM txn")
def q_fraud_summary_check(spark, sf_dir):
    """The bands of a scored table hold every row."""
    r = QUERIES["fraud_summary"](spark, sf_dir)
    banded = F.col("high_risk_transactions") + F.col("medium_risk_transactions") + F.col("low_risk_transactions")
    return r.select(banded.alias("banded"), F.col("average_fraud_probability").between(0, 1).alias("mean_in_range"))


@register("fraud_report_check", f"""WITH {SQL_TXN},
c AS (SELECT is_fraud, cast(floor(0.2 * count(*) + 0.5) AS bigint) AS n FROM txn GROUP BY 1)
SELECT cast(cast(is_fraud AS double) AS varchar) AS label, n AS support FROM c
UNION ALL SELECT l, cast((SELECT sum(n) FROM c) AS bigint) FROM (VALUES ('accuracy'), ('macro avg'), ('weighted avg')) t(l)""")
def q_fraud_report_check(spark, sf_dir):
    """The test part has exactly a fifth of each class."""
    return QUERIES["fraud_report"](spark, sf_dir).select("label", "support")


@register("fraud_importance_check", """SELECT unnest(['transaction_id', 'customer_id', 'amount', 'category', 'transaction_date_hour',
  'transaction_date_day', 'transaction_date_month', 'transaction_date_dayofweek']) AS feature, true AS in_range, 1.0 AS total""")
def q_fraud_importance_check(spark, sf_dir):
    """One importance for each feature; they add up to 1."""
    r = QUERIES["fraud_importance"](spark, sf_dir)
    total = r.agg(F.round(F.sum("importance"), 6).alias("total"))
    return r.crossJoin(F.broadcast(total)).select("feature", F.col("importance").between(0, 1).alias("in_range"), "total")


@register("fraud_train_check", "SELECT 8 AS n_features, true AS accuracy_in_range, true AS auc_in_range")
def q_fraud_train_check(spark, sf_dir):
    r = QUERIES["fraud_train"](spark, sf_dir)
    return r.select("n_features", F.col("accuracy").between(0, 1).alias("accuracy_in_range"),
                    F.col("roc_auc").between(0, 1).alias("auc_in_range"))


@register("model_roundtrip_check", f"WITH {SQL_TXN}\nSELECT count(*) AS n_rows, 0 AS n_differing FROM txn")
def q_model_roundtrip_check(spark, sf_dir):
    r = QUERIES["model_roundtrip"](spark, sf_dir)
    return r.agg(F.count("*").alias("n_rows"), _n(F.col("p_trained") != F.col("p_loaded"), "n_differing"))


@register("iforest_roundtrip_check", f"WITH {SQL_TXN}\nSELECT count(*) AS n_rows, 0 AS n_differing FROM txn")
def q_iforest_roundtrip_check(spark, sf_dir):
    r = QUERIES["iforest_roundtrip"](spark, sf_dir)
    return r.agg(F.count("*").alias("n_rows"), _n(F.col("score_trained") != F.col("score_loaded"), "n_differing"))


@register("iforest_train_check", f"""WITH {SQL_TXN}
SELECT {C.IFOREST_TREES} AS n_trees, least({C.IFOREST_SUBSAMPLE}, count(*)) AS root_rows, 0 AS lost_rows FROM txn""")
def q_iforest_train_check(spark, sf_dir):
    """Every tree holds its whole sample, and a node's rows are those of its children."""
    n = QUERIES["iforest_train"](spark, sf_dir)
    kid = n.select("tree", F.col("node").alias("kid"), F.col("size").alias("kid_size"))
    inner = n.where("NOT leaf").select("tree", "node", "size", F.explode(F.array("left", "right")).alias("kid"))
    lost = inner.join(kid, ["tree", "kid"], "left").groupBy("tree", "node", "size").agg(F.sum("kid_size").alias("s")) \
        .agg(_n(F.col("s") != F.col("size"), "lost_rows"))
    roots = n.where("node = 0").agg(F.count("*").alias("n_trees"), F.min("size").alias("root_rows"))
    return roots.crossJoin(lost)


@register("iforest_scores_check", f"WITH {SQL_TXN}\nSELECT count(*) AS n_rows, count(DISTINCT transaction_id) AS n_ids, 0 AS outside FROM txn")
def q_iforest_scores_check(spark, sf_dir):
    r = QUERIES["iforest_scores"](spark, sf_dir)
    return r.agg(F.count("*").alias("n_rows"), F.countDistinct("transaction_id").alias("n_ids"),
                 _n((F.col("score") >= 0) | (F.col("score") < -1) | F.isnan("score"), "outside"))


@register("iforest_decision_check", f"WITH {SQL_TXN}\nSELECT count(*) AS n_rows, 0 AS wrong_flag, true AS share_is_contamination FROM txn")
def q_iforest_decision_check(spark, sf_dir):
    """A hundredth of the rows (to a row) lies below the threshold, and only those are flagged."""
    r = QUERIES["iforest_decision"](spark, sf_dir)
    return r.agg(F.count("*").alias("n_rows"), _n(F.col("is_anomaly") != (F.col("decision") < 0), "wrong_flag"),
                 (F.abs(F.count_if("is_anomaly") - 0.01 * F.count("*")) <= 1).alias("share_is_contamination"))


@register("iforest_metrics_check", f"""WITH {SQL_TXN}
SELECT count(*) AS total_samples, true AS counts_agree, true AS rate_is_contamination FROM txn""")
def q_iforest_metrics_check(spark, sf_dir):
    r = QUERIES["iforest_metrics"](spark, sf_dir)
    n, a = F.col("total_samples"), F.col("anomalies_detected")
    return r.select("total_samples", (F.round(F.col("anomaly_rate") * n) == a).alias("counts_agree"),
                    (F.abs(a - 0.1 * n) <= 1).alias("rate_is_contamination"))


#: A small forest of two trees over (amount, customer_id).
_NODES = pd.DataFrame([
    (0, 0, 0, 100.0, 1, 2, 8, 0, False), (0, 1, 0, 50.0, 3, 4, 7, 1, False), (0, 2, -1, 0.0, -1, -1, 1, 1, True),
    (0, 3, -1, 0.0, -1, -1, 5, 2, True), (0, 4, -1, 0.0, -1, -1, 2, 2, True),
    (1, 0, 1, 40.0, 1, 2, 8, 0, False), (1, 1, -1, 0.0, -1, -1, 4, 1, True), (1, 2, 0, 80.0, 3, 4, 4, 1, False),
    (1, 3, -1, 0.0, -1, -1, 3, 2, True), (1, 4, -1, 0.0, -1, -1, 1, 2, True)],
    columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth", "leaf"])


def _fixed_forest_sql() -> str:
    c = {n: repr(float(IF.c_factor(np.array([n]))[0])) for n in (1, 2, 3, 4, 5, 8)}
    return f"""WITH {SQL_TXN},
h AS (SELECT transaction_id,
  CASE WHEN amount < 100 THEN CASE WHEN amount < 50 THEN 2 + {c[5]} ELSE 2 + {c[2]} END ELSE 1 + {c[1]} END AS h0,
  CASE WHEN customer_id < 40 THEN 1 + {c[4]} ELSE CASE WHEN amount < 80 THEN 2 + {c[3]} ELSE 2 + {c[1]} END END AS h1 FROM txn),
s AS (SELECT transaction_id, -power(2.0, -((h0 + h1) / 2) / {c[8]}) AS score FROM h),
q AS (SELECT quantile_cont(score, 0.1) AS o FROM s)
SELECT transaction_id, round(score, 6) AS score, round(score, 9) < round(o, 9) AS is_anomaly FROM s, q"""


@register("iforest_fixed_forest", _fixed_forest_sql())
def q_iforest_fixed_forest(spark, sf_dir):
    """MLU-2 and MLU-4 on a forest that SQL can walk."""
    t = txn(spark, sf_dir)
    model = IF.IForestModel(features=["amount", "customer_id"], nodes=_NODES, psi=8)
    s = IF.score_samples(model, t, "transaction_id")
    from ..functions.quantiles import exact_quantiles
    offset = exact_quantiles(s, [("score", 0.1)])[("score", 0.1)]
    return s.select("transaction_id", r6(F.col("score")).alias("score"),
                    (F.round("score", 9) < F.round(F.lit(offset), 9)).alias("is_anomaly"))


#: A forest of two trees and two classes over (amount, customer_id), with class counts at each node.
_FRAUD_NODES = pd.DataFrame([
    (0, 0, 0, 120.0, 1, 2, 100, False, (80.0, 20.0), 0.32, 0.12), (0, 1, -1, 0.0, -1, -1, 70, True, (66.0, 4.0), 0.1077551, -1.0),
    (0, 2, 1, 30.0, 3, 4, 30, False, (14.0, 16.0), 0.4977778, 0.05), (0, 3, -1, 0.0, -1, -1, 12, True, (3.0, 9.0), 0.375, -1.0),
    (0, 4, -1, 0.0, -1, -1, 18, True, (11.0, 7.0), 0.4753086, -1.0),
    (1, 0, 1, 55.0, 1, 2, 90, False, (70.0, 20.0), 0.3456790, 0.02), (1, 1, 0, 60.0, 3, 4, 50, False, (34.0, 16.0), 0.4352, 0.09),
    (1, 2, -1, 0.0, -1, -1, 40, True, (36.0, 4.0), 0.18, -1.0), (1, 3, -1, 0.0, -1, -1, 25, True, (24.0, 1.0), 0.0768, -1.0),
    (1, 4, -1, 0.0, -1, -1, 25, True, (10.0, 15.0), 0.48, -1.0)],
    columns=["tree", "node", "feature", "threshold", "left", "right", "size", "leaf", "stats", "impurity", "gain"])

SQL_FRAUD_WALK = SQL_TXN + """,
p AS (SELECT transaction_id, is_fraud,
  (CASE WHEN amount < 120 THEN 4 / 70.0 WHEN customer_id < 30 THEN 9 / 12.0 ELSE 7 / 18.0 END
   + CASE WHEN NOT customer_id < 55 THEN 4 / 40.0 WHEN amount < 60 THEN 1 / 25.0 ELSE 15 / 25.0 END) / 2 AS probability FROM txn),
w AS (SELECT *, cast(probability > 0.5 AS integer) AS predicted FROM p)"""


def _fixed_fraud(spark) -> FR.FraudModel:
    """A fraud model whose forest is fixed; its features are the raw columns (scaled by 1)."""
    names = ["amount", "customer_id"]
    state = FeatureState(target="is_fraud", scaler={c: (0.0, 1.0) for c in names}, feature_columns=names)
    return FR.FraudModel(state=state, model=PipelineModel(stages=[VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep"),
                                                                  classification_forest(spark, _FRAUD_NODES, 2)]))


@register("fraud_fixed_scores", f"""WITH {SQL_FRAUD_WALK}
SELECT transaction_id, round(probability, 6) AS fraud_probability, predicted AS fraud_prediction,
       CASE WHEN probability <= 0 THEN NULL WHEN probability <= 0.3 THEN 'Low' WHEN probability <= 0.7 THEN 'Medium' ELSE 'High' END AS risk_level FROM w""")
def q_fraud_fixed_scores(spark, sf_dir):
    """MLS-12, 13: a forest that SQL walks."""
    t = txn(spark, sf_dir).select("transaction_id", "customer_id", "amount", "is_fraud")
    return FR.predict_fraud(_fixed_fraud(spark), t).select("transaction_id", r6(F.col("fraud_probability")).alias("fraud_probability"), "fraud_prediction", "risk_level")


@register("fraud_fixed_importance", """WITH g AS (SELECT * FROM (VALUES (0, 'amount', 0.12 * 100), (0, 'customer_id', 0.05 * 30), (1, 'customer_id', 0.02 * 90), (1, 'amount', 0.09 * 50)) t(tree, feature, gain)),
s AS (SELECT feature, sum(gain / total) AS i FROM (SELECT *, sum(gain) OVER (PARTITION BY tree) AS total FROM g) GROUP BY feature)
SELECT feature, round(i / (SELECT sum(i) FROM s), 6) AS importance, (SELECT count(*) FROM events) AS scored FROM s""")
def q_fraud_fixed_importance(spark, sf_dir):
    """MLS-11: importances of the forest that scores the table."""
    n = FR.predict_fraud(_fixed_fraud(spark), txn(spark, sf_dir)).agg(F.count("fraud_probability").alias("scored"))
    return FR.feature_importance(_fixed_fraud(spark), spark).withColumn("importance", r6(F.col("importance"))).crossJoin(F.broadcast(n))


@register("fraud_fixed_metrics", f"""WITH {SQL_FRAUD_WALK},
c AS (SELECT count(*) FILTER (WHERE is_fraud = 1 AND predicted = 1) AS tp, count(*) FILTER (WHERE is_fraud = 0 AND predicted = 1) AS fp,
             count(*) FILTER (WHERE is_fraud = 1 AND predicted = 0) AS fn, count(*) AS n, count(*) FILTER (WHERE is_fraud = predicted) AS hit FROM w)
SELECT tp, fp, fn, round(hit / n, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall FROM c""")
def q_fraud_fixed_metrics(spark, sf_dir):
    """MLS-6..9: the evaluation of a scored table, every row."""
    scored_ = FR.predict_fraud(_fixed_fraud(spark), txn(spark, sf_dir)).select("is_fraud", "fraud_prediction")
    cells = M.confusion_matrix(scored_, "is_fraud", "fraud_prediction").agg(
        *(F.coalesce(F.sum(F.when((F.col("actual") == a) & (F.col("predicted") == p), F.col("count"))), F.lit(0)).alias(n) for n, a, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0))))
    rep = M.classification_report(scored_, "is_fraud", "fraud_prediction").where("label = '1'").select(r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"))
    acc = M.accuracy(scored_, "is_fraud", "fraud_prediction").select(r6(F.col("accuracy")).alias("accuracy"))
    return cells.crossJoin(acc).crossJoin(rep)


@register("pipeline_model_check", f"WITH {SQL_TXN_ORDERS}\nSELECT count(*) AS n_rows, 0 AS n_differing, 0 AS n_seen_unseen FROM txn_orders")
def q_pipeline_model_check(spark, sf_dir):
    """SNK-2, SNK-3: one saved pipeline holds features, scaler, forest and threshold."""
    t = txn_orders(spark, sf_dir)
    st = FeatureState()
    X = prepare_features(t, st, "", keep=["transaction_id"], fit=True)
    m = IF.train_iforest(X, st.feature_columns, "__transaction_id")
    path = scratch_path(spark, "pipeline-model")
    ST.anomaly_pipeline(m, st, spark).write().save(path)
    back = PipelineModel.load(path).transform(t).select("transaction_id", "anomaly_score", "is_anomaly")
    own = IF.detect(m, X, "__transaction_id").select(F.col("__transaction_id").alias("transaction_id"), F.col("anomaly_score").alias("own"), F.col("is_anomaly").alias("flag"))
    # a category that the fit never saw has the code -1, whatever text it is
    odd = [PipelineModel.load(path).transform(t.withColumn("category", F.lit(x))).select("transaction_id", F.col("anomaly_score").alias(f"s{i}")) for i, x in enumerate(("never", "ever"))]
    unseen = odd[0].join(odd[1], "transaction_id").agg(_n(F.col("s0") != F.col("s1"), "n_seen_unseen"))
    return (back.join(own, "transaction_id").agg(F.count("*").alias("n_rows"), _n((F.abs(F.col("anomaly_score") - F.col("own")) > 1e-12) | (F.col("is_anomaly") != F.col("flag")), "n_differing"))
            .crossJoin(unseen))


@register("chunk_recursive_check", """SELECT doc_id, true AS in_bounds, true AS in_order, true AS nothing_lost FROM documents
WHERE length(regexp_replace(text, '\\s', '', 'g')) > 0""")
def q_chunk_recursive_check(spark, sf_dir):
    """Chunks are at most the wanted size and numbered without gaps, each is
    part of its document, and together they hold all of its characters."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    chunks = QUERIES["chunk_recursive"](spark, sf_dir)
    per = chunks.groupBy("doc_id").agg(F.max(F.length("chunk")).alias("longest"), F.count("*").alias("n"), F.max("chunk_no").alias("last"),
                                       F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))).alias("c"))
    bare = lambda t: F.length(F.regexp_replace(t, r"(?U)\s", ""))
    held = F.aggregate("c", F.lit(0), lambda acc, x: acc + bare(x["chunk"]))
    part = F.forall("c", lambda x: F.instr(F.col("text"), x["chunk"]) > 0)
    return docs.join(per, "doc_id").select("doc_id", (F.col("longest") <= C.CHUNK_SIZE).alias("in_bounds"),
                                           (part & (F.col("last") == F.col("n") - 1)).alias("in_order"), (held >= bare(F.col("text"))).alias("nothing_lost"))


@register("flow_full_check", f"""WITH {SQL_TXN}
SELECT (SELECT count(*) FROM txn) AS n_predictions, (SELECT count(*) FROM txn) AS n_documents, {len(C.RUN_QUESTIONS)} AS n_prompts""")
def q_flow_full_check(spark, sf_dir):
    """The full run scores and documents every row and asks every question."""
    r = PL.full_run(txn(spark, sf_dir))
    return (r.predictions.agg(F.count("*").alias("n_predictions"))
            .crossJoin(r.chunks.agg(F.countDistinct("row_id").alias("n_documents")))
            .crossJoin(r.prompts.agg(F.count("*").cast("int").alias("n_prompts"))))


@register("flow_unsupervised_check", f"WITH {SQL_TXN_ORDERS}\nSELECT true AS share_is_contamination, count(*) AS n_rows FROM txn_orders")
def q_flow_unsupervised_check(spark, sf_dir):
    r = PL.full_run(txn_orders(spark, sf_dir))
    n = r.predictions.agg(F.count("*").alias("n_rows"))
    return r.risk.crossJoin(n).select((F.abs(F.col("total_anomalies") - 0.1 * F.col("n_rows")) <= 1).alias("share_is_contamination"), "n_rows")


@register("flow_page_check", f"WITH {SQL_TXN}\nSELECT count(*) AS n_rows, least(10, count(*)) AS n_alerts, true AS worst_first FROM txn")
def q_flow_page_check(spark, sf_dir):
    """The page run flags a hundredth of the rows; the alerts are the lowest scores."""
    from .q_clean import txn_text
    page = PL.page_run(txn_text(spark, sf_dir))
    worst = page.flagged.agg(F.min("anomaly_score").alias("low"), F.count("*").alias("n_rows"))
    shown = page.alerts.agg(F.count("*").alias("n_alerts"), F.min("anomaly_score").alias("first"))
    return worst.crossJoin(shown).select("n_rows", "n_alerts", (F.col("low") == F.col("first")).alias("worst_first"))


del ML  # imported for its registrations
