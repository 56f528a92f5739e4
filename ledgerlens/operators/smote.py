"""SMOTE oversampling (MLS-4) with exact k nearest minority neighbours.

Neighbour search never emits all pairs:

* up to ``local_limit`` minority rows (checked) the minority matrix is a
  broadcast variable and each partition of query rows computes its k nearest
  with numpy, emitting only k rows per query;
* above it, points are cut by a k-d tree (each node along the coordinate that
  spreads most) into cells of about ``block`` points.  A cell and a bounded
  part of its queries is one ``applyInPandas`` group that emits local top-k;
  a per-query top-k merge follows.  Pass 1 searches each query's own cell;
  the k points found are real, so the true k-th distance is at most r, and
  pass 2 sends each query only to the cells whose box lies within its own r:
  exact.
* a vector shared by more than k points never enters the search (see
  ``knn``), so hot duplicates cannot make one slab hold a third of the rows.

Synthetic rows are ``x + u * (nn - x)`` with the base row, the neighbour
rank and ``u`` drawn from md5 hashes of the synthetic row number, so the
output is deterministic and independent of partitioning."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.exprs import md5_unit
from ..config import LIMITS
from ..functions.indexing import sorted_dictionary
from ..functions.partitioning import ensure_parallelism
from ..session import ensure_checkpoint_dir, stored

KNN_SCHEMA = "qid long, rank long, nid long, dist double"


def _local_knn(qids, qx, cids, cx, k):
    """k nearest candidates per query (self excluded), ties by candidate id."""
    order = np.argsort(cids, kind="stable")
    cids, cx = cids[order], cx[order]
    parts = []
    for s in range(0, len(qids), 256):
        q = qx[s:s + 256]
        # sum of squared differences, dimension by dimension (exact, no cancellation)
        d = np.zeros((len(q), len(cx)))
        for j in range(cx.shape[1]):
            diff = q[:, j, None] - cx[None, :, j]
            d += diff * diff
        d[qids[s:s + 256, None] == cids[None, :]] = np.inf
        kk = min(k, d.shape[1])
        # the k-th smallest distance per row in O(n); every candidate at or
        # under it (ties included) is then ordered exactly by (distance, id)
        kth = np.partition(d, kk - 1, axis=1)[:, kk - 1]
        r_i, c_i = np.nonzero(d <= kth[:, None])
        dist = d[r_i, c_i]
        o = np.lexsort((c_i, dist, r_i))                 # columns are in id order
        r_i, c_i, dist = r_i[o], c_i[o], dist[o]
        first = np.searchsorted(r_i, r_i, side="left")
        rank = np.arange(len(r_i)) - first + 1
        keep = (rank <= kk) & np.isfinite(dist)
        parts.append(pd.DataFrame({
            "qid": qids[s:s + 256][r_i[keep]].astype(np.int64),
            "rank": rank[keep].astype(np.int64),
            "nid": cids[c_i[keep]].astype(np.int64),
            "dist": dist[keep]}))
    if not parts:
        return pd.DataFrame({"qid": [], "rank": [], "nid": [], "dist": []}).astype(
            {"qid": "int64", "rank": "int64", "nid": "int64", "dist": "float64"})
    return pd.concat(parts, ignore_index=True)


def knn(points: DataFrame, id_col: str, vec_col: str, k: int, local_limit: int | None = None,
        block: int | None = None) -> DataFrame:
    """Exact k nearest neighbours within ``points`` (qid, rank, nid, dist);
    ties by neighbour id, the point itself excluded.

    A vector shared by more than k points answers its own points directly:
    their k nearest are the k smallest other ids of that vector (distance 0).
    The k+1 smallest ids per vector come from a ``row_number() <= k+1``
    filter, which Spark limits map-side, so a vector held by a third of the
    rows never reaches one task whole.  Only points of rarer vectors are
    searched, against at most k representatives per distinct vector."""
    local_limit = LIMITS.knn_local if local_limit is None else local_limit
    block = LIMITS.knn_block if block is None else block
    pts = points.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    wv = Window.partitionBy("v").orderBy("id")
    top = pts.withColumn("_r", F.row_number().over(wv)).where(F.col("_r") <= k + 1)
    sizes = pts.groupBy("v").agg(F.count(F.lit(1)).alias("_g"))
    lists = top.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("_r", "id"))).alias("_l")) \
        .join(sizes, "v")
    hot = stored(lists.where(F.col("_g") > k), "hot-vectors")
    hot_pts = pts.join(hot, "v")                      # broadcast if small, else skew-split
    others = F.filter(F.col("_l.id"), lambda x: x != F.col("id"))
    direct = (hot_pts.select(F.col("id").alias("qid"), F.slice(others, 1, k).alias("_ns"))
              .select("qid", F.posexplode("_ns").alias("_p", "nid"))
              .select("qid", (F.col("_p") + 1).cast("long").alias("rank"), "nid", F.lit(0.0).alias("dist")))
    queries = pts.join(hot.select("v"), "v", "left_anti")
    cands = top.where(F.col("_r") <= k).select("id", "v")
    return _search(queries, cands, k, local_limit, block).unionByName(direct)


def _search(queries: DataFrame, cands: DataFrame, k: int, local_limit: int, block: int) -> DataFrame:
    spark = queries.sparkSession
    m = cands.count()
    if m <= local_limit:
        pdf = cands.toPandas()   # bounded by the check above
        ids = pdf["id"].to_numpy(np.int64)
        mat = np.array(pdf["v"].tolist(), dtype=np.float64).reshape(len(pdf), -1)
        bc = spark.sparkContext.broadcast((ids, mat))

        def run(it):
            cids, cx = bc.value
            for b in it:
                if len(b):
                    qx = np.array(b["v"].tolist(), dtype=np.float64).reshape(len(b), -1)
                    yield _local_knn(b["id"].to_numpy(np.int64), qx, cids, cx, k)
        return ensure_parallelism(queries).mapInPandas(run, KNN_SCHEMA)
    return _knn_blocks(queries, cands, k, m, block)


#: Rows (at most twice as many) of the sample that the cells are cut by, and its rows in a cell at least.
CELL_SAMPLE, CELL_SAMPLE_ROWS = 65_536, 8

FOUND_SCHEMA = KNN_SCHEMA + ", cell long, v array<double>"


def _matrix(v) -> np.ndarray:
    return np.array(v.tolist(), dtype=np.float64).reshape(len(v), -1)


def _cell_tree(sample: np.ndarray, leaf: int) -> tuple[np.ndarray, int]:
    """(nodes as rows of coordinate, cut, child at or under it, child above it;
    number of cells).  A cell has coordinate -1 and its number as child.

    A node is cut in the middle between the quartiles of the coordinate where
    these lie farthest apart, so a quarter of the sample's rows at least is on
    either side also when values repeat; where one value fills the middle half
    of every coordinate, at the mean of the one that varies most."""
    nodes, todo, cells = [(-1, 0.0, 0, 0)], [(0, np.arange(len(sample)))], 0
    while todo:
        i, rows = todo.pop()
        if len(rows) > leaf:
            p = sample[rows]
            lo, hi = np.quantile(p, [0.25, 0.75], axis=0)
            j = int(np.argmax(hi - lo))
            cut = (lo[j] + hi[j]) / 2
            if not hi[j] > lo[j]:
                j = int(np.argmax(p.std(axis=0)))
                cut = p[:, j].mean()
            above = p[:, j] > cut
            if above.any() and not above.all():
                n = len(nodes)
                nodes[i] = (j, cut, n, n + 1)
                nodes += [(-1, 0.0, 0, 0)] * 2
                todo += [(n, rows[~above]), (n + 1, rows[above])]
                continue
        nodes[i] = (-1, 0.0, cells, cells)
        cells += 1
    return np.array(nodes), cells


def _cells_of(x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while True:
        j = nodes[at, 0].astype(np.int64)
        if not (j >= 0).any():
            return nodes[at, 2].astype(np.int64)
        child = np.where(x[rows, np.maximum(j, 0)] > nodes[at, 1], nodes[at, 3], nodes[at, 2])
        at = np.where(j >= 0, child, at).astype(np.int64)


def _box_gaps(qlo, qhi, lo, hi):
    """Squared distances from query boxes (points: both corners alike) to cell
    boxes, added up in the order of ``_local_knn``."""
    d = np.zeros((len(qlo), len(lo)))
    for j in range(lo.shape[1]):
        gap = np.fmax(np.fmax(lo[None, :, j] - qhi[:, j, None], qlo[:, j, None] - hi[None, :, j]), 0.0)
        d += gap * gap
    return d


def _reached(qx, r, lo, hi):
    """(query row, box row) of all boxes that lie within the query's squared distance r."""
    out = [np.zeros((0, 2), np.int64)]
    r = r * (1 + 1e-9) + 1e-12
    for s in range(0, len(qx), 256):
        q, qr = qx[s:s + 256], r[s:s + 256]
        near = np.nonzero(_box_gaps(q.min(axis=0)[None], q.max(axis=0)[None], lo, hi)[0] <= qr.max())[0]
        q_i, b_i = np.nonzero(_box_gaps(q, q, lo[near], hi[near]) <= qr[:, None])
        out.append(np.stack([q_i + s, near[b_i]], axis=1))
    return np.concatenate(out)


def _knn_blocks(queries: DataFrame, pts: DataFrame, k: int, m: int, block: int) -> DataFrame:
    """Block search over cells of a k-d tree; every query is also a candidate
    (queries are the points of non-hot vectors, all of which are candidates).

    The tree is cut on a bounded sample of the points (``CELL_SAMPLE``) into
    cells of about ``block`` points (above CELL_SAMPLE / CELL_SAMPLE_ROWS cells
    they grow); every point is placed, and the boxes are those of all points of
    a cell, so the sample has no part in the result.  Pass 1 searches each
    query's own cell; the k points found bound its true k-th distance by r.
    Pass 2 sends the query to the other cells whose box lies within r: exact.
    A cell is sent once to each part of its queries (about 4 blocks)."""
    spark = pts.sparkSession
    ensure_checkpoint_dir(spark)
    pts = pts.select("id", "v").checkpoint(eager=True)
    share = max(1, math.ceil(m / CELL_SAMPLE))
    rows = pts.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).select("v").limit(2 * CELL_SAMPLE).collect()   # bounded
    sample = np.array([r["v"] for r in rows or pts.select("v").take(1)], dtype=np.float64)
    tree, cells = _cell_tree(sample, max(CELL_SAMPLE_ROWS, math.ceil(block * len(sample) / m)))

    @F.pandas_udf("long")
    def cell_of(v: pd.Series) -> pd.Series:
        return pd.Series(_cells_of(_matrix(v), tree), dtype="int64")

    placed = pts.withColumn("cell", cell_of("v")).checkpoint(eager=True)
    qplaced = queries.select("id", "v", cell_of("v").alias("cell"))
    dim = sample.shape[1]
    corners = [f(F.col("v")[j]).alias(f"{n}{j}") for n, f in (("l", F.min), ("h", F.max)) for j in range(dim)]
    found = placed.groupBy("cell").agg(*corners).collect()       # a row per cell of the bounded tree
    names = np.array([b["cell"] for b in found], dtype=np.int64)
    lo, hi = (np.array([[b[f"{n}{j}"] for j in range(dim)] for b in found], dtype=np.float64) for n in "lh")
    boxes = spark.sparkContext.broadcast((names, lo, hi))

    def searched(pdf):
        q, c = pdf[pdf["role"] == 0], pdf[pdf["role"] == 1]
        if q.empty or c.empty:
            return pd.DataFrame({"qid": [], "rank": [], "nid": [], "dist": []}).astype(
                {"qid": "int64", "rank": "int64", "nid": "int64", "dist": "float64"})
        return _local_knn(q["id"].to_numpy(np.int64), _matrix(q["v"]), c["id"].to_numpy(np.int64), _matrix(c["v"]), k)

    def own_cell(pdf):
        near = searched(pdf)
        q = pdf[pdf["role"] == 0]
        if q.empty:
            return near.assign(cell=-1, v=None)
        per = near.groupby("qid")["dist"].agg(["max", "size"])
        r = q["id"].map(per["max"].where(per["size"] >= k)).fillna(math.inf).to_numpy(np.float64)
        cell, lo, hi = boxes.value
        hit = _reached(_matrix(q["v"]), r, lo, hi)
        hit = hit[cell[hit[:, 1]] != pdf["cell"].iloc[0]]
        to = pd.DataFrame({"qid": q["id"].to_numpy(np.int64)[hit[:, 0]], "rank": 0, "nid": 0, "dist": 0.0,
                           "cell": cell[hit[:, 1]], "v": q["v"].to_numpy()[hit[:, 0]]})
        return pd.concat([near.assign(cell=-1, v=None), to], ignore_index=True)

    wq = Window.partitionBy("qid").orderBy("dist", "nid")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(wq).cast("long")).where(F.col("rank") <= k)

    cands = placed.select("cell", "id", "v", F.lit(1).alias("role"))
    # pass 1: own cell (every query's cell holds candidates: queries are candidates)
    own = qplaced.select("cell", "id", "v", F.lit(0).alias("role")).unionByName(cands)
    found = stored(own.groupBy("cell").applyInPandas(own_cell, FOUND_SCHEMA), "own-cells")
    first = found.where("cell < 0").select("qid", "rank", "nid", "dist")
    if cells == 1:
        return best(first)
    need = found.where("cell >= 0").select("cell", F.col("qid").alias("id"), "v", F.lit(0).alias("role"))
    parts = need.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(4 * block)).cast("int").alias("parts"))
    parts = F.broadcast(stored(parts, "cell-parts"))              # a row per cell
    q = need.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    c = cands.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    second = q.unionByName(c).groupBy("cell", "part").applyInPandas(searched, KNN_SCHEMA)
    return best(first.unionByName(second))


def smote(train: DataFrame, features: list[str], label: str = "__label", id_col: str = "__row_id",
          k: int = C.SMOTE_NEIGHBOURS, seed: int = C.SEED, minority=1) -> DataFrame:
    """Synthetic minority rows until both classes have the same count.
    Returns only the synthetic rows (features, label); the caller unions."""
    spark = train.sparkSession
    counts = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_min = counts.get(float(minority), counts.get(minority, 0))
    n_maj = sum(v for key, v in counts.items() if key != minority and key != float(minority))
    k_eff = min(k, n_min - 1)
    if n_min < 2 or n_maj <= n_min:
        return spark.createDataFrame([], train.select(*features, label).schema)
    # the minority part is read by the neighbour search and twice by the
    # generation joins: written once, so none of those re-scans the training set
    ensure_checkpoint_dir(spark)
    mino = train.where(F.col(label) == minority).select(
        F.col(id_col).cast("long").alias("id"), F.array(*[F.col(c).cast("double") for c in features]).alias("v")) \
        .checkpoint(eager=True)
    nn = knn(mino, "id", "v", k_eff)
    dic, _ = sorted_dictionary(mino.select(F.col("id").alias("value")))
    n_gen = n_maj - n_min
    parts = max(spark.sparkContext.defaultParallelism, n_gen // 2_000_000 + 1)
    gen = spark.range(0, n_gen, 1, parts).select(
        F.col("id").alias("syn"),
        F.floor(md5_unit(F.col("id"), seed=f"{seed}:base") * n_min).cast("long").alias("code"),
        (F.floor(md5_unit(F.col("id"), seed=f"{seed}:nn") * k_eff) + 1).cast("long").alias("rank"),
        md5_unit(F.col("id"), seed=f"{seed}:step").alias("u"))
    # each minority row gets its k neighbours' vectors once (a minority-sized
    # table); a neighbour at distance 0 is the row's own vector and needs no join,
    # so the ids that a hot vector's points share are never a join key
    own = nn.select("qid", "rank", "nid", "dist").join(mino.select(F.col("id").alias("qid"), F.col("v").alias("bv")), "qid")
    near = (own.where("dist = 0").select("qid", "bv", "rank", F.col("bv").alias("nv"))
            .unionByName(own.where("dist <> 0").join(mino.select(F.col("id").alias("nid"), F.col("v").alias("nv")), "nid")
                         .select("qid", "bv", "rank", "nv")))
    lists = near.groupBy("qid").agg(F.first("bv").alias("bv"), F.array_sort(F.collect_list(F.struct("rank", "nv"))).alias("_near"))
    coded = dic.select(F.col("value").alias("qid"), "code").join(lists, "qid").select("code", "bv", "_near")
    # the one join of all draws
    base = gen.join(coded, "code").withColumn("nv", F.col("_near")[(F.col("rank") - 1).cast("int")]["nv"])
    newv = F.zip_with("bv", "nv", lambda a, b: a + F.col("u") * (b - a))
    out = base.select(newv.alias("_v"))
    return out.select(*[F.col("_v")[i].alias(c) for i, c in enumerate(features)],
                      F.lit(minority).cast(train.schema[label].dataType).alias(label))
