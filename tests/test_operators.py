"""Property checks for the rows-only operators."""
import numpy as np
from pyspark.sql import functions as F

from ledgerlens.functions import columns as P
from ledgerlens.operators import iforest as IF
from ledgerlens.operators import retrieval as RT
from ledgerlens.sources.views import read_table, txn

from .conftest import SF_SMALL


def test_recursive_chunks_bounded_and_cover(spark):
    text = ("alpha beta gamma\n\n" * 120) + ("x" * 2500) + "\nend line here"
    chunks = RT.split_recursive(text)
    assert all(len(c) <= 1000 for c in chunks)
    joined = "".join(chunks)
    for word in ("alpha", "gamma", "end line here"):
        assert word in joined
    assert sum(len(c) for c in chunks) >= len(text.replace("\n\n", "").replace(" ", "")) * 0.5


def test_recursive_chunk_rows(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    ch = RT.chunk_recursive(docs, "doc_id", "text")
    assert ch.agg(F.max(F.length("chunk"))).first()[0] <= 1000
    assert ch.select("doc_id").distinct().count() == docs.where(F.length(F.trim("text")) > 0).count()


def test_fixed_chunks_cover_whole_text(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    ch = RT.chunk_fixed(docs, "doc_id", "text")
    last = ch.groupBy("doc_id").agg(F.max("chunk_no").alias("n"))
    j = docs.join(last, "doc_id").select(F.length("text").alias("L"), "n")
    assert j.where((F.col("n") * 800 + 1000 < F.col("L"))).count() == 0


def test_planted_outlier_ranks_first(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(2000, 2)))]
    rows.append((9999, 12.0, -12.0))
    df = spark.createDataFrame(rows, "rid bigint, a double, b double")
    m = IF.train_iforest(df, ["a", "b"], "rid", contamination=0.01)
    top = IF.detect(m, df, "rid").orderBy("anomaly_score").first()
    assert top["rid"] == 9999 and top["is_anomaly"]


def test_column_resolvers(spark):
    t = txn(spark, SF_SMALL)
    assert P.amount_column(t) == "amount"
    assert P.customer_column(t) == "customer_id"
    assert P.date_columns_by_name(t) == ["transaction_date"]
    assert P.first_temporal(t) == "transaction_date"
    assert P.label_column(t) == "is_fraud"
    assert P.stats_label_column(t) == "is_fraud"
    assert P.category_column(t) == "category"
    assert P.numeric_columns(t) == ["transaction_id", "customer_id", "amount", "is_fraud"]
    assert P.time_column_page(t) is None
    o = spark.createDataFrame([(1, 2.0, "m", 0)], "Time long, Amount double, merchant string, Class int")
    assert P.amount_column(o, ["Amount", "amount"]) == "Amount"
    assert P.time_column_page(o) == "Time"
    assert P.label_column(o) == "Class"
    assert P.category_column(o) == "merchant"


def test_topk_plans_group_limit(spark):
    e = read_table(spark, SF_SMALL, "embeddings")
    q = RT.centroid(e, "embedding", "label")
    plan = RT.top_k(e, "vec_id", "embedding", q, "label")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_vectorised_tree_walk_matches_scalar(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(rng.normal(size=(500, 3)))]
    df = spark.createDataFrame(rows, "rid bigint, a double, b double, c double")
    m = IF.train_iforest(df, ["a", "b", "c"], "rid", n_trees=20)
    got = {r["rid"]: r["score"] for r in IF.score_samples(m, df, "rid").collect()}
    nodes = {(int(t), int(n)): r for t, n, r in zip(m.nodes["tree"], m.nodes["node"], m.nodes.itertuples())}
    cpsi = float(IF.c_factor(np.array([m.psi]))[0])
    for rid, a, b, c in rows[:50]:
        x = (a, b, c)
        total = 0.0
        for t in sorted(m.nodes["tree"].unique()):
            n = nodes[(int(t), 0)]
            while not n.leaf:
                n = nodes[(int(t), int(n.left if x[n.feature] < n.threshold else n.right))]
            total += n.depth + float(IF.c_factor(np.array([n.size]))[0])
        want = -2.0 ** (-(total / m.nodes["tree"].nunique()) / cpsi)
        assert abs(got[rid] - want) < 1e-12


def test_ingest_report_size_and_rows(spark):
    import os
    from ledgerlens.sources.readers import ingest_report
    path = f"{SF_SMALL}/events.parquet"
    r = ingest_report(spark, path).first()
    assert r["filename"] == "events.parquet" and r["rows"] == 1000
    assert abs(r["size_mb"] - os.path.getsize(path) / (1024 * 1024)) < 1e-12
    assert r["columns"] == "event_id,ts,user_id,event_type,value,props"


def test_native_scores_equal_the_numpy_walk(spark):
    """Scores on the JVM to 1e-12 of numpy's, with missing features and values on the thresholds."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 3)).round(1)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "rid bigint, a double, b double, c double")
    m = IF.train_iforest(df, ["a", "b", "c"], "rid", n_trees=30, subsample=64)
    m.nodes.loc[~m.nodes["leaf"], "threshold"] = m.nodes.loc[~m.nodes["leaf"], "threshold"].round(1)
    m.forest = None
    odd = [(1000, float("nan"), 0.1, 0.2), (1001, None, None, None), (1002, 0.1, float("inf"), float("-inf"))]
    rows = np.concatenate([x, np.array([[np.nan if v is None else v for v in r[1:]] for r in odd], float)])
    got = IF.score_samples(m, df.union(spark.createDataFrame(odd, df.schema)), "rid").orderBy("rid").toPandas()
    assert np.abs(got["score"].to_numpy() - IF.walk(m, rows)).max() < 1e-12
    plan = IF.score_samples(m, df, "rid")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_native_scores_on_a_stream(spark, tmp_path):
    df = spark.range(200).select("id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    m = IF.train_iforest(df, ["a", "b"], "id", n_trees=5, subsample=32)
    df.write.parquet(f"{tmp_path}/in")
    stream = IF.add_score(m, spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(60)
    got = {r["id"]: r["score"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {r["id"]: r["score"] for r in IF.score_samples(m, df, "id").collect()} and len(got) == 200
