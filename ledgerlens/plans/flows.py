"""The reference's two end-to-end flows as one lazy Spark plan each.

A. full run: load -> clean -> features -> {anomaly records, model scores}
   -> {risk summary, trends, documents} -> retrieval prompts -> summary.
B. page run: load (coerce, impute, scale) -> isolation forest -> alerts ->
   report -> one-document corpus.

The cleaned table feeds many consumers, so it is checkpointed (reliable
storage under ``spark.checkpoint.dir``): recomputation after a lost executor
starts from there, not from the raw files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import numeric_columns, training_label_column, with_row_id
from ..operators import anomaly as A
from ..operators import clean as K
from ..operators import features as FE
from ..operators import fraud as FR
from ..operators import iforest as IF
from ..operators import report as R
from ..operators import retrieval as RT
from ..operators import stats as S
from ..operators.bundle import ModelBundle, save_models
from ..session import ensure_checkpoint_dir, stored
from ..sources.readers import load_transactions


@dataclass
class RunResult:
    processed: DataFrame
    records: DataFrame
    stats: DataFrame
    predictions: DataFrame
    risk: DataFrame
    metrics: dict = field(default_factory=dict)
    report: DataFrame | None = None
    prompts: DataFrame | None = None
    chunks: DataFrame | None = None
    summary: DataFrame | None = None


def full_run(source: DataFrame | str, row_id: str = "transaction_id", questions=tuple(C.RUN_QUESTIONS),
             corpus_cap: int | None = None, model_path: str | None = None,
             spark: SparkSession | None = None) -> RunResult:
    """The full run over a table, or over the file at a path.  Every row gets a
    document; ``corpus_cap`` keeps the first so many instead (the reference's
    demo setting).  With ``model_path`` the fitted models are saved there."""
    df = load_transactions(spark or SparkSession.getActiveSession(), source) if isinstance(source, str) else source
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    processed = with_row_id(FE.one_hot(FE.calendar_features(K.clean(df))), row_id).checkpoint(eager=True)
    bundle = ModelBundle()
    records = A.anomaly_records(processed, row_id)
    stats = S.dataset_stats(processed, records)
    label = training_label_column(processed)
    metrics: dict = {}
    if label is not None:
        fm = FR.train_fraud_model(processed, label, row_id)
        # the risk summary, the documents and the report read them: scored once
        predictions = stored(FR.predict_fraud(fm, processed), "predictions")
        metrics = fm.metrics
        bundle.fraud = fm
    else:
        st = FE.FeatureState()
        X = FE.prepare_features(processed, st, "", keep=[row_id], fit=True)
        model = IF.train_iforest(X, st.feature_columns, f"__{row_id}")
        det = IF.detect(model, X, f"__{row_id}").select(
            F.col(f"__{row_id}").alias(row_id), F.col("is_anomaly").cast("int").alias("is_anomaly"),
            "anomaly_score")
        predictions = processed.join(det, row_id)
        metrics = {"training": IF.training_metrics(model, X, f"__{row_id}")}
        bundle.iforest, bundle.iforest_state = model, st
    if model_path is not None:
        save_models(bundle, model_path)
    risk = R.risk_summary(predictions)
    kept = predictions if corpus_cap is None else RT.capped_rows(predictions, row_id, corpus_cap)
    docs = RT.row_documents(kept, row_id).select("row_id", "page_content")
    texts = RT.row_text(docs.select("row_id", F.col("page_content").alias("content")), "row_id",
                        text_columns=["content"])
    chunks = RT.chunk_recursive(texts, "row_id", "text")
    qdf = spark.createDataFrame(list(enumerate(questions)), "query_id int, query string")
    hits = RT.search_texts(chunks, ["row_id", "chunk_no"], "chunk", qdf, "query_id", "query")
    prompts = RT.pack_prompt(hits, "query_id", "query", "chunk")
    report = R.text_report(predictions)
    summary = R.final_summary(report, risk, records)
    return RunResult(processed, records, stats, predictions, risk, metrics, report, prompts, chunks, summary)


@dataclass
class PageResult:
    processed: DataFrame
    original: DataFrame
    flagged: DataFrame
    alerts: DataFrame
    report: DataFrame
    report_chunks: DataFrame
    n_imputed: int
    median: float | None


def page_run(df: DataFrame, row_id: str = "transaction_id",
             contamination: float = C.IFOREST_CONTAMINATION_PAGE) -> PageResult:
    named = row_id in df.columns
    # a made id is stored with the table, so that every reader sees the same one
    df = df if named else with_row_id(df, row_id).checkpoint(eager=True)
    processed, original, n_imp, med = K.page_load(df, row_id)
    numbers = set(numeric_columns(processed))
    feats = [c for c in processed.columns if c != "Class" and c in numbers]
    model = IF.train_iforest(processed, feats, row_id, contamination=contamination)
    det = IF.detect(model, processed, row_id).select(row_id, F.col("decision").alias("anomaly_score"), "is_anomaly")
    flagged = processed.join(det, row_id)
    alerts = R.alert_list(flagged, original, row_id)
    report = R.anomaly_report(flagged, original, row_id)
    chunks = RT.chunk_fixed(report.select(F.lit(0).cast("bigint").alias("doc_id"), "report"), "doc_id", "report")
    return PageResult(processed, original, flagged, alerts, report, chunks, n_imp, med)
