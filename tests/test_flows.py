"""The two end-to-end flows on the driver tables."""
from pyspark.sql import functions as F

from ledgerlens.plans import flows as PL
from ledgerlens.plans.q_clean import txn_text
from ledgerlens.sources.views import txn, txn_orders

from .conftest import SF_SMALL


def test_full_run_supervised(spark):
    r = PL.full_run(txn(spark, SF_SMALL))
    text = r.summary.first()["summary"]
    for part in ("Financial Transaction Analysis Summary", "Risk Assessment:", "High Risk:",
                 "Amount at Risk: $", "Anomalies Detected: 16 unusual transactions"):
        assert part in text
    assert r.predictions.count() == 1000
    assert r.prompts.count() == 3
    assert r.prompts.agg(F.min("n_sources")).first()[0] == 5
    assert 0.0 <= r.metrics["roc_auc"].first()["roc_auc"] <= 1.0


def test_full_run_unsupervised(spark):
    r = PL.full_run(txn_orders(spark, SF_SMALL))
    risk = r.risk.first()
    assert "total_anomalies" in r.risk.columns and "high_risk_transactions" not in r.risk.columns
    n = r.predictions.count()
    assert abs(risk["total_anomalies"] - 0.1 * n) <= 1


def test_page_run(spark):
    r = PL.page_run(txn_text(spark, SF_SMALL))
    assert r.n_imputed > 0
    assert r.alerts.count() == 10
    rep = r.report.first()["report"]
    assert "Total transactions processed: 1000" in rep and "Total anomalies detected: 10" in rep
    assert r.report_chunks.count() >= 1
