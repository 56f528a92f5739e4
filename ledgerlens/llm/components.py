"""Connected components of a link table.

Each task first contracts the links it reads to a forest of stars (bounded
memory, vectorised); what several tasks know of one component is then joined by
alternating large-star and small-star steps, which are grouped minima and
equi-joins.  No component is ever held whole by one task or the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import discard, release, store

#: Links that a task holds before it contracts them.
HELD = 500_000
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars with the components of the links: ``(node, smallest node)``, roots left out."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    low = np.arange(len(ids))
    while True:
        lx, ly = low[x], low[y]
        open_ = lx != ly
        if not open_.any():
            break
        x, y, lx, ly = x[open_], y[open_], lx[open_], ly[open_]
        m = np.minimum(lx, ly)
        np.minimum.at(low, lx, m)
        np.minimum.at(low, ly, m)
        while (jump := low[low]).tobytes() != low.tobytes():
            low = jump
    child = np.flatnonzero(low != np.arange(len(ids)))
    return ids[child], ids[low[child]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    held, size = [], 0

    def out(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_LINKS)

    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        size += batch.num_rows
        if size > HELD:
            a, b = forest(np.concatenate([a, *(h[0] for h in held)]), np.concatenate([b, *(h[1] for h in held)]))
            held, size = [], 0
            if len(a) > 2 * HELD:                    # more nodes than a task should hold: pass them on
                yield out(a, b)
                a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = forest(np.concatenate([a, *(h[0] for h in held)]), np.concatenate([b, *(h[1] for h in held)]))
    yield out(a, b)
    release()


def _stars(e: DataFrame) -> DataFrame:
    """A large-star and a small-star step over links ``(a, b)``, a > b.

    Large star: every neighbour above ``u`` is linked to the smallest node next
    to ``u`` (itself included).  Small star: the same for the neighbours below
    ``u`` and ``u`` itself.  The minima are map-side combined aggregates, stored
    before the joins back: with an aggregate on the key in the join's own stage
    adaptive skew splitting would not act on a star's centre.
    """
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
    m = store(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "minima")
    large = store(both.where("v > u").join(m, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large-star")
    m = store(large.groupBy("a").agg(F.min("b").alias("m")), "minima")
    return (large.join(m, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
            .union(m.select("a", "m")).toDF("a", "b").where("a <> b"))


def _is_final(e: DataFrame) -> bool:
    """Whether the links are stars: a node with a parent has one, and no children."""
    roles = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        e.select("b", F.lit(0), F.lit(1)))
    odd = roles.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)")
    return odd.isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``links``: the smallest node
    reachable from it.  Null ends and self links are ignored; repeated and
    reversed links count once; no links give no rows.

    Each round is stored in the shared folder; rounds stop when the links are
    stars, after O(log^2 n) rounds at most.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    e = links.where(x.isNotNull() & y.isNotNull() & (x != y)).select(x.alias("a"), y.alias("b"))
    e = store(e.mapInArrow(_contract, "a long, b long"), "links")
    while not _is_final(e):
        # a stored table is read in few, well filled tasks, so contracting it again joins most of what is left
        nxt = store(_stars(e).mapInArrow(_contract, "a long, b long"), "links")
        discard(e)
        e = nxt
    return (e.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .union(e.select("b", "b").distinct()))
