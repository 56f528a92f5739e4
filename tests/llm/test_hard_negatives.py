"""Subset-sum scores and mined negatives against plain products and loops."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import hard_negatives as H

from .helpers import with_clashes


@pytest.mark.parametrize("dims, reach", [(64, 256), (13, 5), (8, 1), (3, 1 << 40), (0, 1), (70, 1 << 20)])
def test_scores_are_the_inner_products(dims, reach):
    rng = np.random.default_rng(dims)
    a, c = rng.integers(-reach, reach + 1, (9, dims)), rng.integers(-reach, reach + 1, (31, dims))
    with np.errstate(over="ignore"):
        want = a @ c.T
    planes = H.bit_planes(c)
    assert (H.scores(planes, H.subset_sums(a, len(planes))) == want).all()


def brute(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    rows = list(dict.fromkeys((i, l, tuple(math.floor(256 * x) for x in v)) for i, l, v in rows
                              if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)))
    out = []
    for i, l, v in rows:
        if is_anchor(i):
            other = [(sum(x * y for x, y in zip(v, w)), j, m) for j, m, w in rows if j != i and len(w) == len(v)]
            for ps, p, _ in sorted((o for o in other if o[2] == l), key=lambda o: (-o[0], o[1]))[:positives]:
                found = sorted((o for o in other if o[2] != l and low * ps <= 100 * o[0] <= high * ps), key=lambda o: (-o[0], o[1]))[:negatives]
                out += [(i, p, r, n, ps, s) for r, (s, n, _) in enumerate(found, 1)]
    return sorted(out)


def result(df, **kw):
    out = H.mine(df, F.col("vec_id") % 10 == 0, **kw)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(8, 13)) / 3
    x = base[rng.integers(0, 8, 400)] + rng.normal(size=(400, 13)) / 8
    x[100:160] = x[100]                                            # ties
    rows = [(int(i), int(l), [float(z) for z in v]) for i, l, v in zip(rng.permutation(900)[:400], rng.integers(0, 4, 400), x)]
    odd = [(None, 1, rows[0][2]), (5000, None, rows[0][2]), (5010, 1, None), (5020, 1, [None] + rows[0][2][1:]), (5030, 1, [float("nan")] * 13),
           (5040, 1, [float("inf")] + rows[0][2][1:]), (5050, 1, []), (5060, 2, []), (5070, 1, [1.0, 2.0]), (5080, 1, [1.0, 1.5]), (5081, 3, [0.5, 1.0]),
           (5090, 77, rows[3][2]), (6000, 1, [0.0] * 13), (-10, 2, rows[7][2]), (6010, 0, rows[1][2]), (6010, 0, rows[2][2]), (6010, 3, rows[2][2])]
    return rows + rows[:40] + odd


@pytest.mark.parametrize("cells", [{}, {"candidates_cell": 60, "anchors_cell": 7}])
def test_mined_rows_equal_brute_force(spark, rows, cells):
    df = with_clashes(spark.createDataFrame([(i, l, v, "clash") for i, l, v in rows], "vec_id long, label int, embedding array<double>, aid string")).withColumn("rank", F.lit("clash"))
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 500 and result(df, **cells) == want


def test_small_tiles_and_other_windows(spark, rows, monkeypatch):
    monkeypatch.setattr(H, "TILE", 17)
    monkeypatch.setattr(H, "BLOCK", 3)
    import pyarrow as pa
    clean = [r for r in dict.fromkeys((i, l, tuple(v)) for i, l, v in rows if None not in (i, l, v) and len(v) == 13 and all(z is not None and math.isfinite(z) for z in v))]
    t = pa.table({"vec_id": [r[0] for r in clean], "label": [r[1] for r in clean], "q": [[math.floor(256 * z) for z in r[2]] for r in clean]})
    at = [n for n, r in enumerate(clean) if r[0] % 10 == 0]
    a = t.take(at).append_column("aid", pa.array(range(len(at))))
    got = H.nearest(a, t, 13, 3).to_pylist()
    by = {n: [] for n in range(len(at))}
    for r in got:
        by.setdefault(r["aid"], []).append((r["score"], r["other"]))
    a = a.append_column("positive_scores", pa.array([[s for s, _ in by[n]] for n in range(len(at))]))
    hits = H.in_windows(a, t, 13, 4, 10, 95).to_pylist()
    found = sorted((clean[at[h["aid"]]][0], by[h["aid"]][h["nth"]][1], h["other"], by[h["aid"]][h["nth"]][0], h["score"]) for h in hits)
    want = brute([r for r in clean], lambda i: i % 10 == 0, 3, 4, 10, 95)
    assert found == sorted((i, p, n, ps, s) for i, p, _, n, ps, s in want)


def test_nothing_to_mine(spark, rows):
    df = spark.createDataFrame(rows[:30], "vec_id long, label int, embedding array<double>")
    assert result(df.limit(0)) == [] and result(df.where("vec_id % 10 <> 0")) == []
    assert result(df.withColumn("label", F.lit(1))) == []
