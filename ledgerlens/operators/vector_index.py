"""Exact nearest-neighbour search over stored vectors (RET-5, RET-6).

Items lie in cells around centres, and a cell is cut into rings by the distance
from its centre; a ring's distance interval bounds, by the triangle inequality,
how near any of its items can be to a query.  An item is kept twice: whole, and
as one byte a dimension together with its distance from what the bytes say.  A
search reads bytes first, and whole vectors only of items that can still be
among the k nearest:

1. each query reads the rings nearest to it that hold k items; the k-th smallest
   upper bound there bounds its k-th distance;
2. it reads all other rings within that bound; what lies beyond the k-th
   smallest upper bound found by now is dropped;
3. the rest is compared by whole vectors.

Tables hold the items in blocks of bounded size.  Centres and rings (bounded
numbers) are broadcast, items never are, and no item meets a query outside of
the rings that the query reads.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import LIMITS
from ..session import stored

#: Items of a cell, about; cells, at most; rings of a cell, at most.
CELL_ITEMS, MAX_CELLS, RINGS = 4096, 4096, 16
#: Centres and byte scales are fitted on so many items, and so many for each cell, at most; any fit is right, since an item's own distance and error are kept.
SAMPLE, SAMPLE_PER_CELL, ROUNDS = 4096, 16, 4
#: Visits of a query that are passed on at once.
VISITS = 1024
#: Lower bounds are made smaller, upper bounds larger by this share, beyond any rounding.
SLACK = 1e-6


def squared_l2(a: Column, b: Column) -> Column:
    """Squared euclidean distance of two equal-length arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda acc, v: acc + v)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def _valid(vec: Column, dims: int) -> Column:
    return vec.isNotNull() & (F.size(vec) == dims) & F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2.0 * (x @ y.T)))


def fit_centres(sample: np.ndarray, cells: int) -> np.ndarray:
    centres = sample[:cells].copy()
    for _ in range(ROUNDS):
        own = np.argmin(_distances(sample, centres), axis=1)
        count = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres[count > 0] = sums[count > 0] / count[count > 0][:, None]
    return centres


@dataclass(frozen=True)
class VectorIndex:
    """The tables of an index below ``path``; ``open`` reads them again in any session."""
    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @staticmethod
    def open(spark: SparkSession, path: str) -> "VectorIndex":
        return VectorIndex(spark, path)

    @staticmethod
    def build(items: DataFrame, ids: Sequence[str], vec_col: str, path: str, cell_items: int | None = None, block: int | None = None) -> "VectorIndex":
        """Writes the index of all rows of ``items``.

        Vectors have the length of the longest; rows whose vector is null, of
        another length or not finite throughout are left out (no distance is
        defined).  Repeated rows and rows with null ids are items of their own.
        An empty table makes an empty index."""
        spark = items.sparkSession
        index, block = VectorIndex(spark, path), block or LIMITS.index_block
        src = items.select(*ids, F.col(vec_col).cast("array<double>").alias("__vec"))
        dims = src.agg(F.max(F.size("__vec"))).first()[0] or 0
        src = src.where(_valid(F.col("__vec"), dims))
        n = src.count()
        cells = min(MAX_CELLS, max(1, -(-n // (cell_items or CELL_ITEMS))))
        rows = src.select("__vec").orderBy(F.xxhash64("__vec"), "__vec").limit(max(SAMPLE, SAMPLE_PER_CELL * cells)).collect()
        sample = np.array([r[0] for r in rows], np.float64).reshape(len(rows), dims)
        centres = fit_centres(sample, cells) if len(sample) else np.zeros((1, dims))
        low = sample.min(axis=0) if len(sample) else np.zeros(dims)
        step = np.maximum((sample.max(axis=0) if len(sample) else low) - low, 1e-12) / 255
        spark.createDataFrame([(list(ids), dims, low.tolist(), step.tolist(), centres.ravel().tolist(), len(centres))],
                              "ids array<string>, dims int, low array<double>, step array<double>, centres array<double>, cells int").coalesce(1).write.parquet(f"{path}/meta")

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "__vec")
        schema = f"{kinds}, __vec array<double>, __item long, __cell int, __far double, __code binary, __err double"
        out = to_arrow_schema(spark.createDataFrame([], schema).schema)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = TaskContext.get().partitionId() << 40
            for b in batches:
                x = _matrix(b.column("__vec"), dims)
                far = _distances(x, centres)
                own = np.argmin(far, axis=1)
                far = np.sqrt(((x - centres[own]) ** 2).sum(axis=1))
                code = np.clip(np.rint((x - low) / step), 0, 255)
                err = np.sqrt(((x - (low + code * step)) ** 2).sum(axis=1))
                code = code.astype(np.uint8)
                new = [pa.array(np.arange(at, at + len(x))), pa.array(own.astype(np.int32)), pa.array(far), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(err)]
                at += len(x)
                yield pa.RecordBatch.from_arrays([*b.columns, *new], schema=out)

        placed = stored(src.mapInArrow(place, schema), "placed")
        vectors = placed.select(*ids, "__vec", "__item", "__cell")
        # sorted by cell, so that a search for few cells reads few row groups
        vectors.repartitionByRange(max(1, -(-n // 100_000)), "__cell", "__item").sortWithinPartitions("__cell", "__item").write.parquet(f"{path}/vectors")
        rings = max(1, min(RINGS, -(-n // (cells * block)) * 4, -(-n // cells)))
        cuts = stored(placed.groupBy("__cell").agg(F.percentile_approx("__far", [i / rings for i in range(1, rings)] or [0.5], 1000).alias("cuts")), "cuts")
        ring = F.size(F.filter("cuts", lambda c: c < F.col("__far"))) if rings > 1 else F.lit(0)
        ringed = stored(placed.drop(*ids, "__vec").join(F.broadcast(cuts), "__cell").withColumn("__ring", ring).drop("cuts"), "ringed")    # MAX_CELLS rows
        (ringed.groupBy("__cell", "__ring").agg(F.min("__far").alias("lo"), F.max("__far").alias("hi"), F.count("*").alias("n"))
         .withColumn("salts", F.ceil(F.col("n") / block).cast("int")).coalesce(1).write.parquet(f"{path}/rings"))
        salts = index.table("rings").select("__cell", "__ring", "salts")

        def pack(key: tuple, t: pa.Table) -> pa.Table:
            return pa.table({**{c: pa.array([k.as_py()], pa.int32()) for c, k in zip(("__cell", "__ring", "__salt"), key)},
                             "items": [t["__item"].to_numpy().astype("<i8").tobytes()], "codes": [b"".join(t["__code"].to_pylist())],
                             "errs": [t["__err"].to_numpy().astype("<f8").tobytes()]})

        (ringed.join(F.broadcast(salts), ["__cell", "__ring"])                                         # MAX_CELLS * RINGS rows
         .withColumn("__salt", F.pmod(F.xxhash64("__item"), F.col("salts")).cast("int"))
         .groupBy("__cell", "__ring", "__salt").applyInArrow(pack, "__cell int, __ring int, __salt int, items binary, codes binary, errs binary")
         .write.parquet(f"{path}/blocks"))
        return index

    def search(self, queries: DataFrame, query_id: str, query_vec: str, k: int, counts: dict | None = None) -> DataFrame:
        """``query_id, ids..., distance, rank``: each query's ``k`` nearest items
        (squared L2, ties by the ids), all if there are fewer.

        Queries whose vector is null, not finite or of another length than the
        items' have no hits; repeated query rows are queries of their own.
        ``counts`` gets the numbers of pairs, of pairs compared by bytes and of
        pairs compared by whole vectors."""
        spark, meta = self.spark, self.table("meta").first()
        ids, dims, block = list(meta["ids"]), meta["dims"], LIMITS.query_block
        low, step = np.array(meta["low"]), np.array(meta["step"])
        centres = np.array(meta["centres"]).reshape(meta["cells"], dims)
        rings = self.table("rings").orderBy("__cell", "__ring").toPandas()                             # MAX_CELLS * RINGS rows at most
        cell, ring, lo, hi, size, salts = (rings[c].to_numpy() for c in ("__cell", "__ring", "lo", "hi", "n", "salts"))
        asked = queries.select(F.col(query_id).alias(query_id), F.col(query_vec).cast("array<double>").alias("__q"))
        asked = stored(asked.where(_valid(F.col("__q"), dims)).withColumn("__query", F.monotonically_increasing_id()), "queries")
        n_queries = asked.count()
        lanes = max(1, -(-n_queries // block))

        def bounds(x: np.ndarray) -> np.ndarray:
            """Queries x rings: no item is nearer."""
            d = _distances(x, centres)[:, cell]
            return np.maximum(0.0, np.maximum(d - hi, lo - d) - SLACK * (d + 1))

        visit = "__query long, __q array<double>, bound double, __cell int, __ring int, __salt int"
        visit_schema = to_arrow_schema(spark.createDataFrame([], visit).schema)

        def visits(first: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    x, limit = _matrix(b.column("__q"), dims), b.column("bound").to_numpy(zero_copy_only=False)
                    near = bounds(x)
                    for i in range(len(x)):
                        order = np.argsort(near[i], kind="stable")
                        seeds = int(np.searchsorted(np.cumsum(size[order]), k)) + 1                   # rings that hold k items
                        take = order[:seeds] if first else order[seeds:][near[i][order[seeds:]] <= limit[i]]
                        at = np.repeat(take, salts[take])
                        salt = np.arange(len(at)) - np.repeat(np.cumsum(salts[take]) - salts[take], salts[take])
                        for s in range(0, len(at), VISITS):
                            some, salted = at[s:s + VISITS], salt[s:s + VISITS]
                            one = b.slice(i, 1).take(pa.array(np.zeros(len(some), np.int64)))
                            yield pa.RecordBatch.from_arrays([one.column("__query"), one.column("__q"), one.column("bound"), pa.array(cell[some].astype(np.int32)),
                                                              pa.array(ring[some].astype(np.int32)), pa.array(salted.astype(np.int32))], schema=visit_schema)
            return run

        found = "__query long, __item long, __cell int, low double, high double"
        empty = to_arrow_schema(spark.createDataFrame([], found).schema).empty_table()

        def scan(key: tuple, blocks: pa.Table, asking: pa.Table) -> pa.Table:
            if not blocks.num_rows or not asking.num_rows:
                return empty
            r = blocks.to_pylist()[0]
            items, errs = np.frombuffer(r["items"], "<i8"), np.frombuffer(r["errs"], "<f8")
            y = low + np.frombuffer(r["codes"], np.uint8).reshape(len(items), dims) * step
            x, limit = _matrix(asking["__q"].combine_chunks(), dims), asking["bound"].to_numpy()
            d = _distances(x, y)
            margin = SLACK * (d + 1)
            under, over = np.maximum(0.0, d - errs - margin), d + errs + margin
            if len(items) > k:
                limit = np.minimum(limit, np.partition(over, k - 1, axis=1)[:, k - 1])
            q, i = np.nonzero(under <= limit[:, None])
            asks = asking["__query"].to_numpy()
            return pa.table([pa.array(asks[q]), pa.array(items[i]), pa.array(np.full(len(q), r["__cell"], np.int32)), pa.array(under[q, i]), pa.array(over[q, i])], schema=empty.schema)

        blocks, parts = self.table("blocks"), ["__cell", "__ring", "__salt"]

        def scanned(asking: DataFrame, first: bool) -> DataFrame:
            going = asking.mapInArrow(visits(first), visit)
            left = blocks
            if lanes > 1:
                going = going.withColumn("__lane", F.pmod(F.xxhash64("__query"), F.lit(lanes)).cast("int"))
                left = blocks.withColumn("__lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
            key = parts + ["__lane"] * (lanes > 1)
            going = stored(going, "visits")
            if counts is not None:
                read = going.select("__query", "__cell", "__ring").distinct().join(self.table("rings"), ["__cell", "__ring"])
                counts["by_bytes"] = counts.get("by_bytes", 0) + (read.agg(F.sum("n")).first()[0] or 0)
            left = left.join(going.select(*key).distinct(), key, "left_semi")
            return stored(left.groupBy(*key).cogroup(going.groupBy(*key)).applyInArrow(scan, found), "found")

        def kth(candidates: DataFrame) -> DataFrame:
            """Each query's k-th smallest upper bound; none if there are fewer candidates."""
            order = Window.partitionBy("__query").orderBy("high", "__item")
            return candidates.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k).groupBy("__query").agg(
                F.max("high").alias("bound"), F.count("*").alias("__n")).where(F.col("__n") >= k).drop("__n")

        near = scanned(asked.withColumn("bound", F.lit(float("inf"))), True)
        limited = asked.join(kth(near), "__query", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        candidates = near.union(scanned(stored(limited, "limited"), False))
        left = stored(candidates.join(kth(candidates), "__query", "left").where(F.col("bound").isNull() | (F.col("low") <= F.col("bound"))).select("__query", "__item", "__cell"), "candidates")
        if counts is not None:
            counts |= {"pairs": n_queries * int(size.sum()), "whole": left.count()}
        cells = [r[0] for r in left.select("__cell").distinct().collect()]                             # MAX_CELLS at most
        vectors = self.table("vectors").where(F.col("__cell").isin(cells)).drop("__cell")
        pairs = left.select("__query", "__item").join(vectors, "__item").join(asked, "__query")
        scored = pairs.select("__query", query_id, *ids, squared_l2(F.col("__vec"), F.col("__q")).alias("distance"))
        w = Window.partitionBy("__query").orderBy("distance", *ids)
        return (scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)
                .select(query_id, *ids, "distance", "rank"))
