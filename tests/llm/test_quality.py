"""The classifier on held-out labels; site rates; the pipeline."""
import math

import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import site_quality as Q

from ..conftest import SF_MID
from .helpers import jaccard_components, prose, with_clashes


def test_held_out_accuracy(spark):
    """Fitted on half of the labels, judged on the other half."""
    docs, labels = spark.read.parquet(f"{SF_MID}/documents.parquet"), spark.read.parquet(f"{SF_MID}/labels.parquet")
    out = Q.classify(docs.select("doc_id", "text", "source", "lang"), labels.where("doc_id % 2 = 0"))
    held = labels.where("doc_id % 2 = 1").join(out, "doc_id").toPandas()
    clean = held[(held.quality == 1) & (held.toxic == 0)]
    assert clean.kept.mean() > 0.95
    assert held[held.quality == 0].kept.mean() < 0.1
    assert held[held.toxic == 1].kept.mean() < 0.25 and held[held.toxic == 1].p_toxic.mean() > 4 * clean.p_toxic.mean()


def test_sparse_sites_follow_the_global_rate(spark):
    rows = [("big", "en", 3.0)] * 400 + [("big", "de", -3.0)] * 400 + [("bad", "en", -3.0)] * 300 + [("tiny", "en", -3.0)] * 1
    ev = spark.createDataFrame(rows, "host string, path string, ev_good double").repartition(4)
    known, k = Q.sites(ev.withColumn("ev_toxic", F.lit(0.0)), {"good": 0.5, "toxic": 0.5})
    each = ev.distinct().join(known, ["host", "path"]).select("*", Q.prior("good", 0.5, k).alias("rate_good"))
    rate = {(r["host"], r["path"]): r["rate_good"] for r in each.collect()}
    own = 1 / (1 + math.exp(3))
    assert abs(rate["big", "de"] - own) < 0.05 and abs(rate["bad", "en"] - own) < 0.05 and rate["big", "en"] > 0.9
    assert rate["tiny", "en"] > rate["bad", "en"]                    # one document says little


def test_rates_equal_plain_loops(spark):
    """Sums, prior strengths and each row's prior without the row itself, by plain Python."""
    import random
    r = random.Random(1)
    rows = [(f"h{r.randrange(5)}", f"p{r.randrange(4)}", r.gauss(0, 2), r.gauss(-2, 1)) for _ in range(400)] + [("alone", "x", 1.0, 1.0)]
    base = {"good": .7, "toxic": .1}
    ev = spark.createDataFrame(rows, "host string, path string, ev_good double, ev_toxic double")
    known, k = Q.sites(ev, base)
    got = ev.join(known, ["host", "path"]).select("*", *(Q.prior(h, base[h], k).alias(f"rate_{h}") for h in Q.HEADS)).collect()
    got = {(x["host"], x["path"], x["ev_good"], x["ev_toxic"]): (x["rate_good"], x["rate_toxic"]) for x in got}
    for at, head in enumerate(("good", "toxic")):
        soft = [1 / (1 + math.exp(-(x[2 + at] + math.log(base[head] / (1 - base[head]))))) for x in rows]
        total, pi = len(rows), (sum(soft) + base[head]) / (len(rows) + 1)
        hosts, paths = {}, {}
        for x, p in zip(rows, soft):
            for d, key in ((hosts, x[0]), (paths, x[:2])):
                n, s = d.get(key, (0, 0.0))
                d[key] = n + 1, s + p

        def strength(groups, rate):
            within = sum(n * rate(key) * (1 - rate(key)) for key, (n, _) in groups.items()) / total
            spread = sum(n * (s / n - rate(key)) ** 2 for key, (n, s) in groups.items()) / total - within * len(groups) / total
            return max(1.0, min(1e6, within / max(spread, 1e-9) - 1))

        kh = strength(hosts, lambda _: pi)
        host_rate = {h: (s + kh * pi) / (n + kh) for h, (n, s) in hosts.items()}
        kp = strength(paths, lambda key: host_rate[key[0]])
        for x, p in zip(rows, soft):
            (hn, hs), (n, s) = hosts[x[0]], paths[x[:2]]
            own_host = (hs - p + kh * pi) / (hn - 1 + kh)
            assert abs(got[x][at] - (s - p + kp * own_host) / (n - 1 + kp)) < 1e-9


def test_edge_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (3, None, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    docs = with_clashes(spark.createDataFrame(
        [(1, prose(1, 50), "s", "en"), (2, "### $$$ " * 30, None, "en"), (3, None, "s", None), (4, "", "s", "en"), (4, "", "s", "en"), (None, "x " * 50_000, "t", "en")],
        "doc_id long, text string, source string, lang string")).withColumn("host", F.lit("clash")).withColumn("path", F.lit("clash"))
    out = Q.classify(docs, labels)
    got = out.collect()
    assert len(got) == 6 and all(0 <= r["p_good"] <= 1 and r["kept"] is not None for r in got)
    assert set(docs.columns) <= set(out.columns)
    assert Q.classify(docs.limit(0), labels).count() == 0
    assert Q.classify(docs, labels.limit(0)).count() == 6


def test_logistic_fit_recovers_a_separation():
    import numpy as np
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = (rng.random(2000) < 1 / (1 + np.exp(-(1 + 2 * x[:, 0] - x[:, 2])))).astype(float)
    w = Q.fit_logistic(x, y)
    assert abs(w[0] - 1) < 0.3 and abs(w[1] - 2) < 0.4 and abs(w[2]) < 0.3 and abs(w[3] + 1) < 0.3


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    schema, seen = docs.schema.simpleString(), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF_MID)
        path = f"{tmp_path}/{i}"
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        seen.append((name, before.toPandas(), docs.toPandas()))
        if i < 4:
            assert docs.schema.simpleString() == schema, name
    (_, d0, d1), (_, _, d2), (_, _, d3), (_, _, d4), (_, _, d5) = seen
    labels = pd.read_parquet(f"{SF_MID}/labels.parquet").set_index("doc_id")
    clean = labels[(labels.quality == 1) & (labels.toxic == 0)].index
    assert len(set(clean) & set(d1.doc_id)) > 0.97 * len(clean)
    comp = jaccard_components(list(zip(d1.doc_id, d1.text)), 5, 80, 100)
    assert set(d2.doc_id) == set(comp.values())
    assert set(d3.doc_id) < set(d2.doc_id)
    assert set(d4.doc_id) == set(d3.doc_id) == set(d5.doc_id)
    assert (d4.n_chars == d4.text.map(len)).all()
    from .test_native import base_spans
    assert not any(base_spans(t) for t in d4.text) and any(base_spans(t) for t in d3.text)
    from tokenizers import Tokenizer
    from ledgerlens.llm.queries import tokenizer_path
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in zip(d4.doc_id, d4.text)}
    assert dict(zip(d5.doc_id, d5.n_tokens)) == want
