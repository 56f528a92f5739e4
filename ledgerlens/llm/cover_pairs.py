"""Embedding near-duplicates by cover trees and dual traversal.

Distances are chords between unit vectors (cosine c is chord sqrt(2 - 2c)), a
metric.  The upper levels are distributed: a cell (at first a label) with too
many points gets separated pivots, points go to their nearest pivot's cell, and
a point is also sent to the cells that could hold a partner, by the distance to
the bisector and by the cell's covering radius.  Each pair meets in exactly one
cell.  Inside a cell a cover tree with halving radii is built; the dual
traversal prunes node pairs farther apart than their radii and the threshold,
takes node pairs within it whole, and compares the rest in blocks.

Equal vectors are one point with a count, so a vector held by very many rows is
one point.  Links are counted, and only a spanning part of them is emitted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import store
from .components import components

#: Points of a cell's chunk; a task holds the trees of two chunks at most.
MAX_CELL = 8192
PIVOTS = 32
MAX_DEPTH = 12
LEAF = 24
EPS = 1e-9
_ROW = "cell string, native boolean, pid long, copies long, x binary, far double"
_ROW_TYPES = pa.schema([("cell", pa.string()), ("native", pa.bool_()), ("pid", pa.int64()), ("copies", pa.int64()),
                        ("x", pa.binary()), ("far", pa.float64())])


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1)


def _chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for cell, pid, copies, v in zip(*(c.to_pylist() for c in batch.columns)):
            x = np.array(v, "<f8")
            x /= np.abs(x).max()
            rows.append((cell, True, pid, copies, (x / math.sqrt(x @ x)).tobytes(), 0.0))
        yield _emit(rows, _ROW_TYPES)


def _separated(theta: float, max_cell: int):
    """Pivots of a cell: farthest-first among the candidates, at least 2.5
    thresholds apart, and no more than it takes to get cells of the wanted size
    (each more pivot means more guests)."""
    schema = pa.schema([("cell", pa.string()), ("pivots", pa.binary()), ("n_pivots", pa.int32())])

    def run(batches):
        for batch in batches:
            rows = []
            for cell, size, cand in zip(*(c.to_pylist() for c in batch.columns)):
                wanted = min(PIVOTS, max(4, 3 * -(-size // max_cell)))
                x = _matrix(cand)
                chosen = [0]
                near = _chords(x, x[:1])[:, 0]
                while len(chosen) < wanted and near.max() >= 2.5 * theta:
                    chosen.append(int(near.argmax()))
                    near = np.minimum(near, _chords(x, x[chosen[-1:]])[:, 0])
                rows.append((cell, np.ascontiguousarray(x[chosen]).tobytes(), len(chosen)))
            yield _emit(rows, schema)
    return run


def _descend(theta: float):
    """Send each row of a split cell to its nearest pivot's cell and, as a guest,
    to those whose Voronoi cell is within the threshold.  Natives are guests of
    lower-numbered cells only, so that a pair meets once."""
    def run(batches):
        for batch in batches:
            cells, native, pid, copies, xs, far, pivots = (c.to_pylist() for c in batch.columns)
            rows, by_cell = [], {}
            for i, p in enumerate(pivots):
                if p is None:
                    rows.append((cells[i], native[i], pid[i], copies[i], xs[i], far[i]))
                else:
                    by_cell.setdefault(cells[i], []).append(i)
            for cell, at in by_cell.items():
                x = _matrix([xs[i] for i in at])
                c = np.frombuffer(pivots[at[0]], "<f8").reshape(-1, x.shape[1])
                if len(c) == 1:                       # too dense to separate: cut by hash later
                    rows += [(cell + "!", native[i], pid[i], copies[i], xs[i], far[i]) for i in at]
                    continue
                d = _chords(x, c)
                apart = _chords(c, c)
                np.fill_diagonal(apart, np.inf)
                best = d.argmin(1)
                sq = d * d
                for r, i in enumerate(at):
                    # distance of the point from the bisectors around each pivot's cell
                    margin = ((sq[r][:, None] - sq[r][None, :]) / (2 * apart)).max(1)
                    for k in np.flatnonzero(margin <= theta + EPS):
                        if native[i] and k > best[r] or native[i] and k == best[r]:
                            continue
                        rows.append((f"{cell}/{k}", False, pid[i], copies[i], xs[i], float(d[r, k])))
                    if native[i]:
                        rows.append((f"{cell}/{best[r]}", True, pid[i], copies[i], xs[i], float(d[r, best[r]])))
            yield _emit(rows, _ROW_TYPES)
    return run


class _Node:
    __slots__ = ("at", "center", "radius", "kids")

    def __init__(self, at, center, radius, kids=()):
        self.at, self.center, self.radius, self.kids = at, center, radius, kids


def cover_tree(x: np.ndarray, at: np.ndarray, reach: float = 2.0) -> _Node:
    """Nested levels with halving radii.  Children that cover only themselves are kept in one bag leaf."""
    center = x[at[0]]
    d = _chords(x[at], center[None])[:, 0]
    radius = float(d.max())
    if len(at) <= LEAF or radius <= 1e-7:
        return _Node(at, center, radius)
    while reach / 2 >= radius:
        reach /= 2
    kids, bag, left = [], [], at
    while len(left):
        inside = _chords(x[left], x[left[:1]])[:, 0] <= reach / 2
        inside[0] = True
        got, left = left[inside], left[~inside]
        if len(got) > 2:
            kids.append(cover_tree(x, got, reach / 2))
        else:
            bag.extend(got.tolist())
    if bag:
        bag = np.array(bag)
        kids.append(_Node(bag, center, float(_chords(x[bag], center[None]).max())))
    return _Node(at, center, radius, kids) if len(kids) > 1 else kids[0] if len(kids[0].at) < len(at) else _Node(at, center, radius)


class Links:
    """Weighted link counts and a spanning forest of the links found."""

    def __init__(self, x: np.ndarray, copies: np.ndarray, cosine: float):
        self.x, self.copies, self.cosine = x, copies, cosine
        self.theta = math.sqrt(2 - 2 * cosine)
        self.count = np.zeros(len(x), np.int64)
        self.root = np.arange(len(x))
        self.edges: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        r = self.root
        while r[i] != i:
            r[i] = r[r[i]]
            i = int(r[i])
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.root[max(a, b)] = min(a, b)
            self.edges.append((i, j))

    def whole(self, a: np.ndarray, b: np.ndarray | None) -> None:
        """Every pair of ``a`` and ``b`` (of ``a`` itself if None) links."""
        if b is None:
            self.count[a] += self.copies[a].sum() - self.copies[a]
            b = a
        else:
            self.count[a] += self.copies[b].sum()
            self.count[b] += self.copies[a].sum()
        for j in b:
            self.join(int(a[0]), int(j))
        for i in a:
            self.join(int(i), int(b[0]))

    def compare(self, a: np.ndarray, b: np.ndarray | None) -> None:
        other = a if b is None else b
        for s in range(0, len(a), 1024):
            part = a[s:s + 1024]
            hit = self.x[part] @ self.x[other].T >= self.cosine
            if b is None:
                hit[np.arange(len(part)), s + np.arange(len(part))] = False
            self.count[part] += hit @ self.copies[other]
            if b is not None:
                self.count[b] += self.copies[part] @ hit
            for i, j in zip(*np.nonzero(hit)):
                self.join(int(part[i]), int(other[j]))

    def dual(self, a: _Node, b: _Node) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a is b:
                if 2 * a.radius <= self.theta - EPS:
                    self.whole(a.at, None)
                elif not a.kids:
                    self.compare(a.at, None)
                else:
                    todo += [(p, q) for i, p in enumerate(a.kids) for q in a.kids[i:]]
                continue
            gap = float(_chords(a.center[None], b.center[None])[0, 0])
            if gap > a.radius + b.radius + self.theta + EPS:
                continue
            if gap + a.radius + b.radius <= self.theta - EPS:
                self.whole(a.at, b.at)
            elif not a.kids and not b.kids:
                self.compare(a.at, b.at)
            elif b.kids and (b.radius > a.radius or not a.kids):
                todo += [(a, q) for q in b.kids]
            else:
                todo += [(p, b) for p in a.kids]


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("w", pa.int64())])


def _cell_links(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        native = np.array(table.column("native").to_pylist(), bool)
        if not native.any():
            return _FOUND.empty_table()
        pid, copies = table.column("pid").to_numpy(), table.column("copies").to_numpy()
        links = Links(_matrix(table.column("x").to_pylist()), copies, cosine)
        own = cover_tree(links.x, np.flatnonzero(native))
        if not table.column("cross")[0].as_py():
            links.dual(own, own)
        if not native.all():
            links.dual(own, cover_tree(links.x, np.flatnonzero(~native)))
        n = np.flatnonzero(links.count)
        e = np.array(links.edges, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(np.concatenate([pid[n], pid[e[:, 0]]]), pa.int64()),
                         "b": pa.array([None] * len(n) + pid[e[:, 1]].tolist(), pa.int64()),
                         "w": pa.array(np.concatenate([links.count[n], np.zeros(len(e), np.int64)]), pa.int64())}, schema=_FOUND)
    return run


def _cells(rows: DataFrame, theta: float, max_cell: int) -> DataFrame:
    """Split cells until each has at most ``max_cell`` natives, then into tasks (see :func:`_chunked`)."""
    rows = store(rows, "cells")
    for depth in range(MAX_DEPTH + 1):
        sizes = rows.where("native").groupBy("cell").agg(F.count("*").alias("n"))
        big = store(sizes.where(F.col("n") > max_cell), "cells-big")
        if big.isEmpty():
            break
        splittable = big.where(~F.col("cell").endswith("!"))
        if depth == MAX_DEPTH or splittable.isEmpty():
            break
        lot = F.xxhash64("pid", F.lit(depth))
        cand = (rows.where("native").join(splittable, "cell")                      # about 2 PIVOTS candidates of a cell
                .where(F.pmod(lot, F.col("n")) < 2 * PIVOTS)
                .groupBy("cell").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct(lot.alias("h"), "x"))), lambda s: s["x"]).alias("cand")))
        pivots = store(cand.mapInArrow(_separated(theta, max_cell), "cell string, pivots binary, n_pivots int"), "pivots").select("cell", "pivots")
        sent = store(rows.join(pivots, "cell", "left").select(*rows.columns, "pivots").mapInArrow(_descend(theta), _ROW), "cells")
        radius = sent.where("native").groupBy("cell").agg(F.max("far").alias("radius"))
        rows = store(sent.join(radius, "cell").where(F.col("native") | (F.col("far") <= F.col("radius") + theta + EPS))
                     .select(*sent.columns), "cells")
    return _chunked(rows, max_cell)


def _chunked(rows: DataFrame, max_cell: int) -> DataFrame:
    """``cell, native, pid, copies, x, cross``: cells as tasks.  Where natives or
    guests are more than ``max_cell``, both are cut into chunks by hash: each chunk
    of natives is a task of its own, and each pair of two chunks of natives, or of one
    and a chunk of guests, is one that compares across only (``cross``)."""
    chunks = lambda n: F.greatest(F.ceil(F.col(n) / max_cell), F.lit(1)).cast("int")
    counts = rows.groupBy("cell").agg(F.count_if("native").alias("n"), F.count_if(~F.col("native")).alias("g"))
    big = store(counts.where((F.col("n") > max_cell) | (F.col("g") > max_cell))
                .select("cell", chunks("n").alias("chunks"), F.when(F.col("g") > 0, chunks("g")).otherwise(0).alias("guests")), "cells-cut")
    out = ["cell", "native", "pid", "copies", "x", "cross"]
    whole = rows.withColumn("cross", F.lit(False))
    if big.isEmpty():
        return whole.select(*out)
    cut = rows.join(F.broadcast(big), "cell").withColumn(
        "own", F.pmod(F.xxhash64("pid", F.lit(-1)), F.when(F.col("native"), F.col("chunks")).otherwise(F.col("guests"))).cast("int"))

    def upto(n: str):
        return F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))

    own = F.col("own")
    pairs = F.when(F.col("native"), F.concat(
        F.transform(upto("chunks"), lambda j: F.struct(F.least(j, own).cast("string").alias("a"), F.greatest(j, own).cast("string").alias("b"),
                                                       (own <= j).alias("native"), (own != j).alias("cross"))),
        F.transform(upto("guests"), lambda j: F.struct(own.cast("string").alias("a"), F.concat(F.lit("g"), j).alias("b"), F.lit(True).alias("native"),
                                                       F.lit(True).alias("cross"))))).otherwise(
        F.transform(upto("chunks"), lambda i: F.struct(i.cast("string").alias("a"), F.concat(F.lit("g"), own).alias("b"), F.lit(False).alias("native"),
                                                       F.lit(True).alias("cross"))))
    cut = (cut.withColumn("to", F.explode(pairs)).select(F.concat_ws("#", "cell", "to.a", "to.b").alias("cell"), "to.native", "pid", "copies", "x", "to.cross"))
    return whole.join(F.broadcast(big), "cell", "left_anti").select(*out).union(cut)


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding",
                    label_col: str = "label", max_cell: int = MAX_CELL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Rows link when their labels are equal and not null and the cosine in double
    precision is at least ``cosine``.  Vectors that are null, empty, zero or
    hold null or non-finite components, and rows with a null id, link with
    nothing (0 links, their own id as component); vectors of different lengths
    don't link.  ``n_links`` counts rows, so repeated rows and equal vectors
    link with each other.  ``component_id`` is the smallest id reachable.  An
    empty table gives no rows.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"), F.col(label_col).cast("string").alias("label"))
    good = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
            & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0))
    good = F.coalesce(good, F.lit(False))
    # a vector is named by 128 bits of hash, so that vectors move once, to become points
    named = v.where(good).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64("v", F.lit(1)))
    points = store(named.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("pid"), F.count("*").alias("copies"), F.first("v").alias("v")), "points")
    start = points.select(F.concat_ws("|", "label", F.size("v")).alias("cell"), "pid", "copies", F.col("v").cast("array<double>").alias("v"))
    cells = _cells(start.mapInArrow(_unit, _ROW), math.sqrt(2 - 2 * cosine), max_cell)
    found = store(cells.groupBy("cell").applyInArrow(_cell_links(cosine), "a long, b long, w long"), "vec-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("pid")).agg(F.sum("w").alias("w"))
    groups = components(found.where("b is not null"))
    per_point = store(points.select("label", "h1", "h2", "pid", "copies").join(counts, "pid", "left")
                      .join(groups.select(F.col("node").alias("pid"), "component"), "pid", "left")
                      .select(F.col("label").alias("l"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), (F.coalesce("w", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                              F.coalesce("component", "pid").alias("component_id")), "per-point")
    good_rows = named.select("vec_id", "label", "h1", "h2").join(
        per_point, (F.col("label") == F.col("l")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
    rest = v.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = good_rows.select("vec_id", "n_links", "component_id").union(rest)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
