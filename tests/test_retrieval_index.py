"""The vector index, the text index and the collection against plain searches."""
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import text_index as TI
from ledgerlens.operators.retrieval import chunk_fixed
from ledgerlens.operators.vector_index import VectorIndex
from ledgerlens.session import scratch_path
from ledgerlens.sources.collection import Collection

from .conftest import SF_SMALL


def nearest(items, queries, k):
    out = []
    for q, v in queries:
        found = sorted((sum((a - b) ** 2 for a, b in zip(v, x)), i) for i, x in items if x is not None and len(x) == len(v) and all(math.isfinite(z) for z in x))
        out += [(q, i, r) for r, (_, i) in enumerate(found[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 12)) * 4
    x = base[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 12)) * .3
    x[500:700] = x[500]                                              # many copies
    return [(int(i), [float(z) for z in v]) for i, v in enumerate(x)]


def test_clustered_vectors_read_few_pairs(spark, clustered):
    items = clustered + [(5000, None), (5001, [1.0]), (5002, [float("nan")] * 12), (5003, [float("inf")] + [0.0] * 11)]
    queries = [(i, clustered[i][1]) for i in (0, 3, 77, 500, 1200)] + [(90, [0.0] * 12), (91, [9.0] * 12)]
    df = spark.createDataFrame(items, "item long, v array<double>").withColumn("rank", F.lit("clash"))
    index = VectorIndex.build(df, ["item"], "v", scratch_path(spark, "vi"), cell_items=75, block=64)
    counts = {}
    q = spark.createDataFrame(queries + [(92, None), (93, [1.0]), (94, [float("nan")] * 12)], "q long, v array<double>")
    got = VectorIndex.open(spark, index.path).search(q, "q", "v", 5, counts)
    assert got.columns == ["q", "item", "distance", "rank"]
    assert sorted((r["q"], r["item"], r["rank"]) for r in got.collect()) == nearest(clustered, queries, 5)
    assert counts["by_bytes"] < counts["pairs"] / 3 and counts["whole"] < counts["pairs"] / 10


def test_given_vectors_need_whole_distances_for_under_a_third(spark):
    """The given vectors lie evenly on a sphere: rings can't be left out there, single items can."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = VectorIndex.build(e, ["vec_id"], "embedding", scratch_path(spark, "vi"))
    from ledgerlens.operators.retrieval import centroid
    counts = {}
    hits = index.search(centroid(e, "embedding", "label"), "label", "query", 5, counts)
    assert hits.count() == 50 and "NestedLoop" not in hits._jdf.queryExecution().executedPlan().toString()
    assert counts["pairs"] == 20_000 and counts["whole"] < counts["pairs"] / 3


def test_small_and_empty_indexes(spark, clustered):
    df = spark.createDataFrame(clustered[:3], "item long, v array<double>")
    index = VectorIndex.build(df, ["item"], "v", scratch_path(spark, "vi"))
    q = spark.createDataFrame([(1, clustered[0][1]), (1, clustered[0][1])], "q long, v array<double>")
    assert index.search(q, "q", "v", 5).count() == 6
    assert index.search(q.limit(0), "q", "v", 5).count() == 0
    empty = VectorIndex.build(df.limit(0), ["item"], "v", scratch_path(spark, "vi"))
    assert empty.search(q, "q", "v", 5).count() == 0


# -- texts ---------------------------------------------------------------------

def plain_words(t):
    return [w for w in re.split("[\x00-/:-@\\[-`{-\x7f]+", (t or "").lower()) if w]


def bucket(w):
    return int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % TI.BUCKETS


def best(chunks, queries, k):
    """``(query, ids, rank)`` over ``(ids, text)`` by plain loops."""
    vectors = {t: Counter(map(bucket, plain_words(t))) for t in {t or "" for _, t in chunks}}
    n, df = len(vectors), Counter(b for v in vectors.values() for b in v)
    out = []
    for q, text in queries:
        tf = Counter(map(bucket, plain_words(text)))
        score = {t: round(sum(c * math.log((n + 1) / (df[b] + 1)) ** 2 * v[b] / math.sqrt(sum(v.values())) for b, c in tf.items() if b in v), 9) for t, v in vectors.items()}
        found = sorted((-score[t or ""], ids) for ids, t in chunks)
        out += [(q, ids, r) for r, (_, ids) in enumerate(found[:k], 1)]
    return sorted(out)


QUERIES = [(0, "the of and"), (1, "What are the main spending patterns, in this dataset?"), (2, "worthless onrein the"), (3, "zzzz qqqq"), (4, ""), (5, "de la que éaux"), (6, "THE the the of")]


@pytest.fixture(scope="module")
def chunks():
    d = pd.read_parquet(f"{SF_SMALL}/documents.parquet")
    return [((int(i), n), t[a:a + 300]) for i, t in zip(d.doc_id[:120], d.text) for n, a in enumerate(range(0, min(len(t), 1500), 300))] + \
        [((9000 + i, 0), "the of and copies of one text") for i in range(50)] + [((9999, 0), None), ((9999, 1), ""), ((9999, 2), " .,!")]


def test_text_index_equals_plain_scores(spark, chunks):
    df = spark.createDataFrame([(*ids, t) for ids, t in chunks], "doc long, no long, t string").withColumn("score", F.lit("clash"))
    index = TI.TextIndex.build(df, ["doc", "no"], "t", scratch_path(spark, "ti"))
    q = spark.createDataFrame([*QUERIES, (7, None)], "q long, words string")
    counts = {}
    got = index.search(q, "q", "words", 5, counts)
    assert got.columns == ["q", "doc", "no", "text", "score", "rank"]
    assert sorted((r["q"], (r["doc"], r["no"]), r["rank"]) for r in got.collect()) == best(chunks, [*QUERIES, (7, "")], 5)
    assert counts["summed"] < counts["postings"]
    texts = dict(chunks)
    assert all(r["text"] == (texts[r["doc"], r["no"]] or "") for r in got.collect())
    empty = TI.TextIndex.build(df.limit(0), ["doc", "no"], "t", scratch_path(spark, "ti"))
    assert empty.search(q, "q", "words", 5).count() == 0


def test_collection_versions(spark):
    d = pd.read_parquet(f"{SF_SMALL}/documents.parquet").head(60)
    now = {int(i): t[:2500] for i, t in zip(d.doc_id, d.text)}
    now[5] = now[6]
    split = lambda df, i, t: chunk_fixed(df, i, t, 400, 100)

    def frame(m):
        return spark.createDataFrame(list(m.items()), "doc_id long, text string")

    def expect(c, docs):
        found = [((i, n), t[a:a + 400]) for i, t in docs.items() for n, a in enumerate(range(0, 1 if len(t) <= 400 else 300 * math.ceil((len(t) - 400) / 300) + 1, 300)) if t]
        assert sorted((r["doc_id"], r["chunk_no"], r["chunk"]) for r in c.chunks().collect()) == sorted((*i, t) for i, t in found)
        q = spark.createDataFrame(QUERIES, "q long, words string")
        got = sorted((r["q"], (r["doc_id"], r["chunk_no"]), r["rank"]) for r in c.search(q, "q", "words", 4).collect())
        assert got == best(found, QUERIES, 4)
        assert c.state["texts"] == len({t for _, t in found})

    root = scratch_path(spark, "collections")
    c0 = Collection.create(spark, root, "notes")
    with pytest.raises(FileExistsError):
        Collection.create(spark, root, "notes")
    c1 = c0.put(frame(now), "doc_id", "text", split)
    assert c1.version == 1 and c1.put(frame(now), "doc_id", "text", split).version == 1           # nothing has changed
    first = dict(now)
    change = {i: t.replace("the", "zebra") + " more" for i, t in now.items() if i % 10 == 0} | {7000: "a new one, the of", 5: "", 8: now[8]}
    now |= change
    c2 = Collection.open(spark, root, "notes").put(frame(change), "doc_id", "text", split)
    assert c2.version == 2 and c2._segments("documents", "doc_id bigint, content binary").where("segment = 1").count() == len(change) - 1
    with pytest.raises(FileExistsError):
        c1.put(frame({1: "late"}), "doc_id", "text", split)                                          # another writer was first
    c3 = c2.remove(spark.createDataFrame([(3,), (10,), (12345,)], "x long"), "x")
    del now[3], now[10]
    expect(c3, now)
    assert {r["doc_id"] for r in c3.documents().collect()} == set(now)
    expect(Collection.open(spark, root, "notes", 1), first)
    c4 = c3.compact()
    expect(Collection.open(spark, root, "notes"), now)
    assert c4.version == 4 and c4.texts().count() == c4.state["texts"] and len(c4.state["segments"]) == 1
    with pytest.raises(FileNotFoundError):
        Collection.open(spark, root, "nothing")
