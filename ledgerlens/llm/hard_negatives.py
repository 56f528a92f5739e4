"""Hard-negative mining with exact integer scores from subset-sum tables.

Components are taken as integers.  For each group of eight dimensions an anchor
has a table with the sums of all 256 subsets of its components there.  A
candidate's components are cut into bit planes, eight dimensions of a plane to a
byte; the byte is the table's index, so a score is a shift and a few lookups for
each plane, and no product is taken.

Anchors and candidates are dealt to cells by hash, and each cell of anchors
meets each cell of candidates in one task.  A first round finds each anchor's
nearest rows of its own label (its positives), a second one the rows of other
labels in the score windows that the positives open.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import store

#: Rows of a candidate cell and of an anchor cell, about; a task holds one of each.
CANDIDATES, ANCHORS = 131_072, 16_384
#: Cells smaller than this are not worth a task.
LEAST = 1024
#: Candidates and anchors scored at once: their scores and tables stay in the cache.
TILE, BLOCK = 2048, 128
NONE = np.iinfo(np.int64).min


def bit_planes(x: np.ndarray) -> np.ndarray:
    """Two's-complement planes of integer rows: planes x groups x rows of bytes, lowest plane first."""
    n, d = x.shape
    lo, hi = (int(x.min()), int(x.max())) if x.size else (0, 0)
    planes = max(hi.bit_length(), (-lo - 1).bit_length() if lo < 0 else 0) + 1
    padded = np.zeros((n, -(-d // 8) * 8), np.int64)
    padded[:, :d] = x
    return np.stack([np.packbits(((padded >> b) & 1).astype(np.uint8).reshape(n, -1, 8), axis=2, bitorder="little")[:, :, 0].T for b in range(planes)])


def subset_sums(a: np.ndarray, planes: int) -> np.ndarray:
    """Groups x 256 x anchors: what each subset of eight components adds up to."""
    m, d = a.shape
    reach = int(np.abs(a).astype(object).sum(axis=1).max()) if a.size and int(np.abs(a).max()) > 1 << 30 else int(np.abs(a).sum(axis=1).max(initial=0))
    kind = np.int32 if reach << planes < 1 << 31 else np.int64
    padded = np.zeros((-(-d // 8) * 8, m), kind)
    padded[:d] = a.T
    out = np.zeros((len(padded) // 8, 256, m), kind)
    for bit in range(8):
        out[:, 1 << bit:2 << bit] = out[:, :1 << bit] + padded[bit::8][:, None, :]
    return out


def scores(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Anchors x candidates, exact: from the highest plane (which counts
    negative) down, doubled and added."""
    total = np.zeros((planes.shape[2], tables.shape[2]), tables.dtype)
    looked = np.empty_like(total)
    for b in range(len(planes) - 1, -1, -1):
        total <<= 1
        for group in range(len(tables)):
            np.take(tables[group], planes[b, group], axis=0, out=looked, mode="clip")
            if b == len(planes) - 1:
                total -= looked
            else:
                total += looked
    return np.ascontiguousarray(total.T)


def _merged(best: np.ndarray, ids: np.ndarray, new: np.ndarray, new_ids: np.ndarray) -> None:
    """Puts new scores into a list of the best (score descending, id ascending), in place."""
    k = len(best)
    if len(new) > 4 * k:                                          # only what reaches the k-th can stay
        near = new >= np.partition(new, len(new) - k)[len(new) - k]
        new, new_ids = new[near], new_ids[near]
    s, i = np.concatenate([best, new]), np.concatenate([ids, new_ids])
    order = np.lexsort((i, ~s))[:k]                                # ~s falls as s rises, over the whole range
    best[:], ids[:] = s[order], i[order]


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(values), dims)


class Candidates:
    """A cell's candidates in the order of label and id, so that a label is one stretch."""

    def __init__(self, t: pa.Table, dims: int):
        ids, labels, x = t["vec_id"].to_numpy(), t["label"].to_numpy(), _matrix(t["q"], dims)
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.planes = ids[order], labels[order], bit_planes(x[order])

    def own(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, "right"))


def nearest(anchors: pa.Table, candidates: pa.Table, dims: int, k: int) -> pa.Table:
    """``aid, score, other``: for each anchor the cell's first ``k`` other rows of its label."""
    c = Candidates(candidates, dims)
    aid, ids, labels, x = anchors["aid"].to_numpy(), anchors["vec_id"].to_numpy(), anchors["label"].to_numpy(), _matrix(anchors["q"], dims)
    best, other, found = np.full((len(aid), k), NONE), np.zeros((len(aid), k), np.int64), np.zeros(len(aid), np.int64)
    for label in np.unique(labels):
        lo, hi = c.own(label)
        mine = np.flatnonzero(labels == label)
        for at in range(0, len(mine) if hi > lo else 0, BLOCK):
            block = mine[at:at + BLOCK]
            tables = subset_sums(x[block], len(c.planes))
            for start in range(lo, hi, TILE):
                near = slice(start, min(start + TILE, hi))
                for row, s in zip(block, scores(c.planes[:, :, near], tables)):
                    take = np.flatnonzero((s >= best[row, -1] if found[row] >= k else np.True_) & (c.ids[near] != ids[row]))
                    found[row] += len(take)
                    if len(take):
                        _merged(best[row], other[row], s[take].astype(np.int64), c.ids[near][take])
    full = np.minimum(found, k)
    there = np.arange(k) < full[:, None]
    return pa.table({"aid": pa.array(np.repeat(aid, full)), "score": pa.array(best[there]), "other": pa.array(other[there])})


def in_windows(anchors: pa.Table, candidates: pa.Table, dims: int, k: int, low: int, high: int) -> pa.Table:
    """``aid, nth, score, other``: for each anchor and each of its positives the
    cell's first ``k`` rows of other labels whose score is between ``low`` and
    ``high`` hundredths of the positive's."""
    c = Candidates(candidates, dims)
    aid, ids, labels, x = anchors["aid"].to_numpy(), anchors["vec_id"].to_numpy(), anchors["label"].to_numpy(), _matrix(anchors["q"], dims)
    # the smallest and largest score of each window, as whole numbers
    windows = [[(n, -((-low * s) // 100), (high * s) // 100) for n, s in enumerate(p)] for p in anchors["positive_scores"].to_pylist()]
    kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, int]] = {}
    for at in range(0, len(aid), BLOCK):
        block = np.arange(at, min(at + BLOCK, len(aid)))
        tables = subset_sums(x[block], len(c.planes))
        own = [c.own(labels[row]) for row in block]
        for start in range(0, len(c.ids), TILE):
            near = slice(start, start + TILE)
            near_ids = c.ids[near]
            for row, s, (lo, hi) in zip(block, scores(c.planes[:, :, near], tables), own):
                other = np.ones(len(s), bool)
                other[max(0, lo - start):max(0, hi - start)] = False
                other &= near_ids != ids[row]
                for n, least, most in windows[row]:
                    if least > most:
                        continue
                    best, names, found = kept.get((row, n)) or (np.full(k, NONE), np.zeros(k, np.int64), 0)
                    if found >= k:
                        least = max(least, int(best[-1]))
                    take = np.flatnonzero((s >= least) & (s <= most) & other)
                    if len(take):
                        _merged(best, names, s[take].astype(np.int64), near_ids[take])
                        kept[row, n] = best, names, found + len(take)
    out = [(int(aid[row]), n, int(s), int(i)) for (row, n), (best, names, found) in kept.items() for s, i in zip(best[:min(k, found)], names[:min(k, found)])]
    cols = list(zip(*out)) if out else [()] * 4
    return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("aid", "nth", "score", "other"), cols)})


def _copies(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def mine(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", scale: float = 256.0,
         positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, candidates_cell: int = CANDIDATES, anchors_cell: int = ANCHORS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` is a condition on ``vec_id`` and ``label``.  A component x counts
    as floor(scale * x); a score is the integer inner product, equal to the one of
    all products, higher first, ties by smaller id.  An anchor's positives are its
    first ``positives`` other rows of the same label; for each positive the first
    ``negatives`` rows of another label with low * positive_score <= 100 * score
    <= high * positive_score are returned, ``rank`` from 1.

    Rows without id, label or vector, or with a null or non-finite component, take
    no part.  Repeated rows count once; rows that share an id but nothing else are
    rows of their own, never compared with one another.  Vectors are compared
    with those of the same length.  Integers are 64 bits wide and wrap beyond.
    Anchors without a positive or without a row in the window give no rows, an
    empty table gives none.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
            .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()
                   & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
            .select("vec_id", "label", F.transform(v, lambda x: F.floor(F.lit(scale) * x)).alias("q")).distinct())
    rows = store(rows.withColumn("dims", F.size("q")), "vectors")
    marked = store(rows.where(anchors).withColumn("aid", F.monotonically_increasing_id()), "anchors")
    n, m = rows.count(), marked.count()
    lanes = max(1, -(-n // candidates_cell), min(-(-n // LEAST), 2 * spark.sparkContext.defaultParallelism))
    blocks = max(1, -(-m // anchors_cell))
    left = rows.withColumn("lane", F.pmod(F.xxhash64("vec_id", "label", "q"), F.lit(lanes)).cast("int")).withColumn("block", _copies(blocks))
    cell = ("lane", "block", "dims")

    def compared(own: DataFrame, fn, schema: str, *args) -> DataFrame:
        own = own.withColumn("block", F.pmod(F.xxhash64("aid"), F.lit(blocks)).cast("int")).withColumn("lane", _copies(lanes))
        empty = spark.createDataFrame([], schema).toArrow().schema

        def run(key: tuple, a: pa.Table, c: pa.Table) -> pa.Table:
            if not a.num_rows or not c.num_rows:
                return empty.empty_table()
            return fn(a, c, key[2].as_py(), *args)

        return own.groupBy(*cell).cogroup(left.groupBy(*cell)).applyInArrow(run, schema)

    first = Window.partitionBy("aid").orderBy(F.desc("score"), "other")
    near = (compared(marked, nearest, "aid long, score long, other long", positives).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= positives)
            .groupBy("aid").agg(F.array_sort(F.collect_list(F.struct("nth", "score", "other"))).alias("p")))
    opened = store(marked.join(near, "aid").withColumn("positive_scores", F.col("p.score")), "positives")
    hits = compared(opened.drop("p"), in_windows, "aid long, nth long, score long, other long", negatives, low, high)
    order = Window.partitionBy("aid", "nth").orderBy(F.desc("score"), "other")
    hits = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    names = opened.select("aid", F.col("vec_id").alias("anchor_id"), F.posexplode("p").alias("nth", "p"))
    return (hits.join(names.withColumn("nth", F.col("nth").cast("long")), ["aid", "nth"])
            .select("anchor_id", F.col("p.other").alias("positive_id"), "rank", F.col("other").alias("negative_id"),
                    F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score")))
