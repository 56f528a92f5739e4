"""Sharding by a k-d tree over document metadata.

Nodes are split at the distributed weighted median of their widest dimension
until every leaf holds its share of the bytes.  Dimensions are the size and the
metadata columns (language, source), coded by the rank of a value's frequency; the widest
is the one whose bytes deviate most, as a part of its whole range.  The points are groups of equal
texts (one row with a count, however many copies there are, and the least codes of its rows), so a tree is built
from pre-aggregated rows.  A median is found by histograms: bytes by node and
bin, narrowed around the crossing bin.  Only bins (a fixed number for each
node) reach the driver.  Ties are split by the text's hash, and a group of
copies too large for a shard's tolerance by the hash of the id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import store

BINS = 1024
#: Ranges of at most this many points are finished on the driver.
FEW = 1024
#: A group of copies above this part of a shard's bytes may be split between shards.
SPLIT_GROUP = 0.02
#: Rows that one task numbers for the slots.
SLOT_ROWS = 4096
#: Values of a metadata column with a code of their own; all rarer ones share the next.
CODES = 1000
SIZE = "size"


@dataclass
class Node:
    """Holds leaves ``first .. first+leaves-1``.  Split by ``cut``: rows whose
    (dimension, text hash) is below it go left; of the group at the cut, the part
    ``share`` by the hash of the id."""
    first: int
    leaves: int
    dim: str = SIZE
    cut: tuple[int, int] = (0, 0)
    share: float = 0.0
    left: "Node | None" = None
    right: "Node | None" = None

    def goes_left(self) -> Column:
        value, hash_at = self.cut
        same = F.col(self.dim) == value
        here = same & (F.col("text_hash") == hash_at)
        part = F.pmod(F.xxhash64("doc_id", F.lit(self.first), F.lit(self.leaves)), F.lit(1 << 30)) < int(self.share * (1 << 30))
        return (F.col(self.dim) < value) | (same & (F.col("text_hash") < hash_at)) | (here & part)

    def grow(self) -> None:
        half = self.leaves // 2
        self.left, self.right = Node(self.first, half), Node(self.first + half, self.leaves - half)

    def shard(self) -> Column:
        """The leaf of a row, by the cuts on its way."""
        if self.left is None:
            return F.lit(self.first)
        return F.when(self.goes_left(), self.left.shard()).otherwise(self.right.shard())


@dataclass
class _Range:
    """Where a node's weighted median is searched: ``lo .. hi`` of a column, with the dimension fixed or not."""
    lo: int
    hi: int
    target: float
    fixed: int | None = None

    @property
    def width(self) -> int:
        return max(1, -(-(self.hi - self.lo + 1) // BINS))

    def column(self, dim: str) -> str:
        return dim if self.fixed is None else "text_hash"

    def holds(self, dim: str) -> Column:
        c = F.col(self.column(dim))
        inside = (c >= self.lo) & (c <= self.hi)
        return inside if self.fixed is None else inside & (F.col(dim) == self.fixed)


def _medians(points: DataFrame, nodes: dict[int, Node], ranges: dict[int, _Range]) -> None:
    """Sets the nodes' cuts.  Each round is one grouped job for all open nodes:
    bytes and points by bin; the crossing bin is the next range.  A range of few
    points is finished on the driver."""
    while ranges:
        here = bin_ = F.lit(None).cast("int")
        for i, r in ranges.items():
            inside = (F.col("node") == i) & r.holds(nodes[i].dim)
            step = F.expr(f"cast((cast({r.column(nodes[i].dim)} as decimal(38,0)) - ({r.lo})) div {r.width} as int)")
            here, bin_ = F.when(inside, F.lit(i)).otherwise(here), F.when(inside, step).otherwise(bin_)
        sums: dict[int, list] = {}
        for x in (points.select(here.alias("i"), bin_.alias("bin"), "weight").where("i is not null")
                  .groupBy("i", "bin").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()):   # at most nodes x BINS rows
            sums.setdefault(x["i"], []).append((x["bin"], int(x["w"]), x["n"]))
        few = {}
        for i in list(ranges):
            r = ranges[i]
            for b, w, n in sorted(sums[i]):
                if w >= r.target or b == max(s[0] for s in sums[i]):
                    break
                r.target -= w
            lo = r.lo + b * r.width
            ranges[i] = r = _Range(lo, min(r.hi, lo + r.width - 1), r.target, r.fixed)
            if n <= FEW:
                few[i] = ranges.pop(i)
            elif r.lo == r.hi and r.fixed is None:              # many texts with one value: by their hash
                ranges[i] = _Range(-(1 << 63), (1 << 63) - 1, r.target, r.lo)
            elif r.lo == r.hi:                                  # many rows of one text
                few[i] = ranges.pop(i)
        if few:
            _finish(points, nodes, few)


def _finish(points: DataFrame, nodes: dict[int, Node], few: dict[int, _Range]) -> None:
    """Cuts of ranges with few distinct (value, text) pairs: their sums are fetched."""
    here = value = F.lit(None).cast("long")
    for i, r in few.items():
        inside = (F.col("node") == i) & r.holds(nodes[i].dim)
        here, value = F.when(inside, F.lit(i)).otherwise(here), F.when(inside, F.col(nodes[i].dim)).otherwise(value)
    sums: dict[int, list] = {}
    for x in (points.select(here.alias("i"), value.alias("v"), "text_hash", "weight", "copies").where("i is not null")
              .groupBy("i", "v", "text_hash").agg(F.sum("weight").alias("w"), F.first("copies").alias("c")).collect()):  # <= nodes x FEW
        sums.setdefault(x["i"], []).append((x["v"], x["text_hash"], int(x["w"]), x["c"]))
    for i, r in few.items():
        left = r.target
        for v, h, w, c in sorted(sums[i]):
            if w >= left:
                break
            left -= w
        # a large group of copies is parted; another group goes whole to the nearer side
        share = min(1.0, max(0.0, left / w)) if c > 1 else float(2 * left >= w)
        nodes[i].cut, nodes[i].share = (v, h), share


def _split(points: DataFrame, level: dict[int, Node], scale: dict[str, float]) -> None:
    """Chooses the dimension of each node of a level and cuts it there.  ``scale``: the whole range of each dimension."""
    w = F.col("weight").cast("double")
    moments = [f(F.col(d).cast("double")).alias(f"{k}_{d}") for d in scale for k, f in (
        ("mean", lambda c: F.sum(w * c) / F.sum(w)), ("square", lambda c: F.sum(w * c * c) / F.sum(w)))]
    spans = {x["node"]: x for x in points.where(F.col("node").isin(list(level))).groupBy("node").agg(
        F.sum("weight").alias("w"), *(f(d).alias(f"{k}_{d}") for d in scale for k, f in (("lo", F.min), ("hi", F.max))), *moments).collect()}
    ranges = {}
    for i, x in spans.items():
        node = level[i]
        # rounded, so that sums in another order choose alike; ties go to the first dimension
        spread = {d: round(math.sqrt(max(0.0, x[f"square_{d}"] - x[f"mean_{d}"] ** 2)) / max(1.0, scale[d]), 9) for d in scale}
        node.dim = max(scale, key=spread.get)
        ranges[i] = _Range(x[f"lo_{node.dim}"], x[f"hi_{node.dim}"], int(x["w"]) * (node.leaves // 2) / node.leaves)
    _medians(points, level, ranges)


def _below(level: dict[int, Node]) -> Column:
    """The nodes (by their first leaves) below those of a level."""
    out = F.col("node")
    for i, n in level.items():
        out = F.when(F.col("node") == i, F.when(n.goes_left(), F.lit(n.left.first)).otherwise(F.lit(n.right.first))).otherwise(out)
    return out


def _coded(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the values of ``column`` as their frequency's rank from 0 (ties by value)."""
    common = (rows.groupBy(F.col(column).alias("__value")).agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), "__value").limit(CODES).collect())
    codes = rows.sparkSession.createDataFrame([(r[0], i) for i, r in enumerate(common)], "__value string, __code long")
    return (rows.join(F.broadcast(codes), F.col(column).eqNullSafe(F.col("__value")), "left")                  # CODES rows
            .withColumn(column, F.coalesce("__code", F.lit(CODES).cast("long"))).drop("__value", "__code"))


def shards(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row of ``docs``; sizes near equal.

    ``size`` is the text's UTF-8 bytes (null: none) plus 8; slots are gapless
    from 0 in each shard, by id within hash ranges.  Equal texts share a shard
    unless their group holds over 2 % of a shard's bytes and the median falls
    into it; then the id's hash decides.  Repeated rows are rows of their own
    (their slots differ); null ids are rows like others.  ``metadata`` columns that
    ``docs`` doesn't have are left out; a null there is a value.  An empty table gives
    no rows; with fewer rows than shards some shards are empty.
    """
    codes = {f"code_{i}": F.col(c).cast("string") for i, c in enumerate(c for c in metadata if c in docs.columns)}
    dims, key = [SIZE, *codes], ["text_hash", "size"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = store(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"), *(v.alias(c) for c, v in codes.items())), "shard-rows")
    if codes:
        coded = rows
        for c in codes:
            coded = _coded(coded, c)
        rows = store(coded, "shard-coded")
    grouped = rows.groupBy(*key).agg(F.count("*").alias("copies"), F.sum("size").alias("weight"), *(F.min(c).alias(c) for c in codes))
    points = store(grouped.withColumn("doc_id", F.lit(None).cast(rows.schema["doc_id"].dataType)), "shard-points")
    total, n = points.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    share = max(1.0, int(total) / n_shards)
    large = points.where((F.col("copies") > 1) & (F.col("weight") > SPLIT_GROUP * share))
    # at most n_shards / SPLIT_GROUP groups are large; their rows are points of their own, other groups are one point
    groups = points.select(*key, *codes)
    apart = rows.drop(*codes).join(F.broadcast(large.select(*key, *codes, "copies")), key)
    parts = apart.select("text_hash", *dims, "copies", F.col("size").alias("weight"), "doc_id")
    points = store(points.join(F.broadcast(large.select(*key)), key, "left_anti")
                   .select("text_hash", *dims, F.lit(1).cast("long").alias("copies"), "weight", "doc_id").union(parts), "shard-split")
    whole = points.agg(*(F.coalesce(F.max(d) - F.min(d), F.lit(0)).alias(d) for d in dims)).first().asDict()
    points, root = points.withColumn("node", F.lit(0)), Node(0, n_shards)
    level = {0: root} if n_shards > 1 and int(n) else {}
    while level:
        _split(points, level, whole)
        for node in level.values():
            node.grow()
        points = store(points.withColumn("node", _below(level)), "shard-level")
        level = {k.first: k for node in level.values() for k in (node.left, node.right) if k.leaves > 1}
    buckets = max(1, math.ceil(int(n) / n_shards / SLOT_ROWS))
    # a row goes where its group goes; both sides are stored, so a text held by very many rows is split by adaptive skew handling
    if codes:
        rows = rows.drop(*codes).join(groups, key)
    placed = rows.select("doc_id", "size", "text_crc32", "text_hash", root.shard().cast("int").alias("shard"),
                          F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket"))
    placed = store(placed, "shard-placed")
    run = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
              .select("shard", "bucket", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before")))
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_hash"))
    return (placed.withColumn("in_bucket", number).join(before, ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("in_bucket") - 1).cast("long").alias("slot")))
