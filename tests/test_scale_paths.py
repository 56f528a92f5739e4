"""The large-data code paths, forced on small inputs and checked against
brute force: exact quantile narrowing, distributed dictionaries and prefix
sums, block kNN."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.indexing import prefix_sums, sorted_dictionary
from ledgerlens.functions.quantiles import exact_modes, exact_quantiles
from ledgerlens.operators.smote import knn


def test_quantiles_narrowing_matches_numpy(spark):
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.exponential(50, 20000), np.full(10000, 7.5)])   # a third tied
    df = spark.createDataFrame([(float(v),) for v in vals], "x double").repartition(8)
    qs = [0.01, 0.25, 0.5, 0.75, 0.99]
    got = exact_quantiles(df, [("x", q) for q in qs], max_candidates=500, accuracy=1000)
    for q in qs:
        assert got[("x", q)] == pytest.approx(float(np.percentile(vals, 100 * q)), rel=1e-12, abs=1e-12)


def test_modes_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "v string")
    assert exact_modes(df, ["v"]) == {"v": "a"}


def test_dictionary_paths_agree(spark):
    vals = spark.range(5000).select((F.col("id") * 7919 % 5000).cast("string").alias("value"))
    small, n1 = sorted_dictionary(vals)
    big, n2 = sorted_dictionary(vals, local_limit=10)
    assert n1 == n2 == 5000
    a = {r["value"]: r["code"] for r in small.collect()}
    b = {r["value"]: r["code"] for r in big.collect()}
    assert a == b
    assert sorted(a, key=a.get) == sorted(a)


def test_prefix_sum_paths_agree(spark):
    df = spark.range(3000).select(((F.col("id") * 37) % 3000).cast("double").alias("s"),
                                  (F.col("id") % 5).cast("double").alias("neg"))
    a = {r["s"]: r["neg_before"] for r in prefix_sums(df, "s", ["neg"]).collect()}
    b = {r["s"]: r["neg_before"] for r in prefix_sums(df, "s", ["neg"], local_limit=100, rows_per_partition=100).collect()}
    assert a == b


def _brute(pts, k):
    ids = np.array([p[0] for p in pts])
    x = np.array([p[1] for p in pts])
    out = {}
    for i, q in enumerate(x):
        d = ((x - q) ** 2).sum(1)
        d[i] = np.inf
        order = np.lexsort((ids, d))[:k]
        out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


def test_block_knn_is_exact(spark):
    rng = np.random.default_rng(3)
    pts = [(i, [float(v) for v in rng.normal(size=3)]) for i in range(600)]
    pts += [(600 + i, [0.5, 0.5, 0.5]) for i in range(350)]      # a vector held by a third of the rows
    pts += [(2000 + i, [1.5, -0.5, 0.25]) for i in range(3)]     # a rare duplicate (3 <= k)
    df = spark.createDataFrame(pts, "id long, v array<double>")
    want = _brute(pts, 5)
    for kw in ({}, {"local_limit": 0, "block": 64}):
        res = knn(df, "id", "v", 5, **kw).collect()
        got = {}
        for r in sorted(res, key=lambda r: (r["qid"], r["rank"])):
            got.setdefault(r["qid"], []).append(r["nid"])
        assert got == want, kw


def test_block_knn_sends_queries_to_few_cells(spark, monkeypatch):
    """Rows dealt to the searching tasks grow with the points, not with points times cells."""
    from pyspark.sql.group import GroupedData
    rng = np.random.default_rng(4)
    pts = [(i, [float(v) for v in x]) for i, x in enumerate(rng.uniform(size=(4000, 5)))]
    pts = [(i, x[:3] + [float(round(4 * v)) / 4 for v in x[3:]] + [0.0]) for i, x in pts]   # two of few values, one constant
    dealt, plain = [], GroupedData.applyInPandas

    def counted(self, func, schema):
        dealt.append(self._df.count())
        return plain(self, func, schema)
    monkeypatch.setattr(GroupedData, "applyInPandas", counted)
    res = knn(spark.createDataFrame(pts, "id long, v array<double>"), "id", "v", 5, local_limit=0, block=64).collect()
    got = {}
    for r in sorted(res, key=lambda r: (r["qid"], r["rank"])):
        got.setdefault(r["qid"], []).append(r["nid"])
    assert got == _brute(pts, 5)
    assert sum(dealt) < 12 * len(pts)


def test_topk_in_many_query_blocks(spark, monkeypatch):
    from ledgerlens.operators import retrieval as RT
    items = spark.createDataFrame([(i, [float(i), float(i % 7)]) for i in range(300)], "id long, v array<double>")
    qs = spark.createDataFrame([(j, [float(j * 3), 1.0]) for j in range(40)], "qid long, q array<double>")
    want = {(r["qid"], r["id"], r["rank"]) for r in RT.top_k(items, "id", "v", qs, "qid", "q", 3).collect()}
    from ledgerlens.config import LIMITS
    monkeypatch.setattr(LIMITS, "query_block", 7)
    got = {(r["qid"], r["id"], r["rank"]) for r in RT.top_k(items, "id", "v", qs, "qid", "q", 3).collect()}
    assert got == want and len(got) == 120


def test_confusion_matrix_has_one_shape(spark):
    from ledgerlens.config import LIMITS
    from ledgerlens.operators import metrics as M
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 3)], "y int, p int")
    want = {(a, b): 0 for a in (1, 2, 3) for b in (1, 2, 3)} | {(1, 1): 1, (1, 2): 1, (2, 2): 1, (3, 3): 1}
    LIMITS.small()
    try:
        got = {(r["actual"], r["predicted"]): r["count"] for r in M.confusion_matrix(df, "y", "p").collect()}
    finally:
        LIMITS.reset()
    assert got == want


def test_quantiles_of_few_hot_values(spark):
    vals = np.array([1.0] * 4000 + [2.0] * 4000 + [3.0] * 2000)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double").repartition(4)
    qs = [0.1, 0.4, 0.5, 0.79997, 0.9]
    got = exact_quantiles(df, [("x", q) for q in qs], max_candidates=100, accuracy=100)
    for q in qs:
        assert got[("x", q)] == pytest.approx(float(np.quantile(vals, q)), abs=1e-9), q


def test_modes_by_counters_equal_counts(spark, monkeypatch):
    """Frequent, tied and all-different values; few rows are shuffled where one value stands out."""
    from collections import Counter
    from ledgerlens.config import LIMITS
    from ledgerlens.functions.quantiles import heavy_values
    rng = np.random.default_rng(2)
    hot = ["hot" if x < .2 else f"v{int(y)}" for x, y in zip(rng.random(20_000), rng.integers(0, 8000, 20_000))]
    cols = {"hot": hot, "tied": [f"t{i % 40}" for i in range(20_000)], "different": [f"d{i:05d}" for i in range(20_000)], "none": [None] * 20_000,
            "two": ["b" if i % 2 else "a" for i in range(20_000)]}
    df = spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} string" for c in cols)).repartition(6)
    want = {c: min(Counter(x for x in v if x is not None).items(), key=lambda i: (-i[1], i[0]))[0] for c, v in cols.items() if c != "none"}
    monkeypatch.setattr(LIMITS, "mode_values", 10)
    monkeypatch.setattr(LIMITS, "mode_counters", 50)
    assert exact_modes(df, list(cols)) == want
    left = heavy_values(df, ["hot", "different"], 50).toPandas().groupby("k").agg({"v": "count", "decided": "min"})
    assert left.loc["hot", "decided"] and left.loc["hot", "v"] < 20 and not ("different" in left.index and left.loc["different", "decided"])


def test_sketch_quantiles_keep_their_error(spark):
    from ledgerlens.functions.quantiles import sketch_quantiles
    from ledgerlens.operators import clean as K
    rng = np.random.default_rng(6)
    vals = np.concatenate([rng.exponential(size=20_000), np.full(10_000, 3.5), [np.nan] * 50])
    df = spark.createDataFrame([(float(v), None) for v in vals], "x double, none double").repartition(7)
    good = np.sort(vals[:-50])
    for q, v in ((q, sketch_quantiles(df, [("x", q)], 0.002)["x", q]) for q in (0.01, 0.25, 0.5, 0.66, 0.99)):
        assert np.searchsorted(good, v, "left") - 0.002 * len(good) <= q * len(good) <= np.searchsorted(good, v, "right") + 0.002 * len(good)
    assert sketch_quantiles(df, [("none", 0.5)], 0.1) == {("none", 0.5): None}
    with pytest.raises(ValueError):
        sketch_quantiles(df, [("x", 0.5)], 0.0)
    filled = K.impute_median(df.select("x"), rank_error=0.01).where("isnan(x) or x is null").count()
    assert filled == 0
