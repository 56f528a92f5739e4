"""N-gram Jaccard join with signature trees.

1. Every text becomes its set of word shingles (64-bit hashes).  Equal sets are
   one set with a count of rows.
2. Candidates: all sets are put in one order, by hash but with the shingles last
   that many texts have.  A set's keys are its prefix, the part of it that two linked
   sets cannot both miss.  Linked sets even share as many keys as their sizes
   demand (``needed``), so sets that meet under keys held by few are paired and the
   pairs counted; sets under a key held by many are joined to a group at once.  No
   link is lost in any order, which decides only how many candidates there are, and
   a passage that many documents share makes no key of a text that has others.
3. In each group a signature tree narrows the candidates: nodes hold the OR of
   their members' token bitmaps and the range of sizes; a dual traversal prunes
   node pairs by the largest possible overlap, and pairs that are connected
   already.  Members are compared within size classes only.  What is left is
   joined to smaller groups.
4. The texts of those are fetched, and the same traversal compares the pairs
   that remain element by element.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import discard, release, sized, slices, store
from .components import components

#: Members of a group that one task decides at once.
BLOCK = 4000
CENTRES = 16
FAN = 8
MAP_BYTES = 64 << 20
SIZE_STEP = 1.6
#: Keys are shuffled in so many rounds, each with the keys of one range.
ROUNDS = 4
#: Sets under a key held by more are not paired with each other but joined to one group.
RUN = 64
#: Shingles that a task counts at once, what makes one of many texts, and how many of those are held.
COUNTED = 2_000_000
OFTEN = 8
FREQUENT = 1 << 20
#: Rows that a task works on or passes on at once.
_ROWS = 100_000
_M = np.uint64(0xFF51AFD7ED558CCD)
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                             0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M
    x = (x ^ (x >> np.uint64(29))) * _C[0]
    return x ^ (x >> np.uint64(32))


def _distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values (sorting small arrays is much faster than ``np.unique``)."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


class Shingles:
    """Texts to sorted arrays of distinct shingle hashes."""

    def __init__(self, k: int):
        self.k = k

    def __call__(self, text: str | None) -> np.ndarray:
        from xxhash import xxh3_64_intdigest
        words = text.encode().lower().split() if text else []       # bytes: A-Z only, white space 0x20 and 0x09-0x0D
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
        width = min(self.k, len(h))
        n = len(h) - width + 1
        out = np.full(n, np.uint64(width))
        for j in range(width):
            out = _mix(out + h[j:j + n] * _C[j % 8])
        return _distinct(out)


def links(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """den * |a & b| >= num * |a | b|, of sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def _bounds() -> list[int]:
    out = [5]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * SIZE_STEP)))
    return out


SIZES = _bounds()


def _class(n: int) -> int:
    return int(np.searchsorted(SIZES, n))


def sketch_bits(c: int) -> int:
    """Bits of a bitmap in size class ``c``: at least two for each token of its largest sets."""
    return 1 << max(6, (2 * SIZES[c] - 1).bit_length())


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """The set's bitmap; one of fewer bits is the OR of this one's halves."""
    out = np.zeros(bits // 64, np.uint64)
    at = (s >> np.uint64(7)) & np.uint64(bits - 1)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    while len(bits) > words:
        bits = bits[:len(bits) // 2] | bits[len(bits) // 2:]
    return bits


_NONE = np.empty(0, np.uint64)


def part_keys(s: np.ndarray, num: int, den: int, frequent: np.ndarray = _NONE) -> np.ndarray:
    """The candidate keys of a sorted set, see the module's text; ``frequent``
    (sorted) are the shingles that come last in the order."""
    often = np.zeros(len(s), bool)
    if len(frequent):
        often = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
    first = np.concatenate([s[~often], s[often]])[:len(s) - -(-len(s) * num // den) + 1]
    return _mix(first + _C[2]).view(np.int64)


def needed(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """How many keys linked sets of these sizes share at least, 0 where sizes forbid a link.

    What both have up to the end of the prefix that ends first is in both prefixes;
    after it come at most as many elements as that set has beyond its prefix."""
    most = np.maximum(a, b)
    need = -(-num * (a + b) // (num + den)) - -(-num * most // den) + 1
    return np.where(den * np.minimum(a, b) >= num * most, need, 0)


def in_rounds(keys: np.ndarray) -> list[np.ndarray]:
    """The keys by the range that they fall in."""
    at = (keys.view(np.uint64) // np.uint64((1 << 64) // ROUNDS)).astype(np.int64)
    return [keys[at == i] for i in range(ROUNDS)]


def _repeated(k: int):
    """``shingle, n`` of the shingles that several of some neighbouring texts have (equal texts count once)."""
    schema = pa.schema([("shingle", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(k)
        held, size, seen = [], 0, set()

        def counted() -> Iterator[pa.RecordBatch]:
            found, n = np.unique(np.concatenate([_NONE, *held]), return_counts=True)
            found, n = found[n > 1].view(np.int64), n[n > 1]
            for at in range(0, len(n), _ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(found[at:at + _ROWS]), pa.array(n[at:at + _ROWS], pa.int64())], schema=schema)

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                if text is None or hash(text) in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(hash(text))
                held.append(shingles(text))
                size += len(held[-1])
                if size >= COUNTED:
                    yield from counted()
                    held, size = [], 0
        yield from counted()
    return run


def _frequent(texts: DataFrame, k: int) -> np.ndarray:
    """Shingles that many texts have, the ``FREQUENT`` most frequent at most, sorted.
    They are counted piece by piece, so one that is rare in all pieces may be
    missing; any choice gives the same links."""
    counts = (texts.select("text").mapInArrow(_repeated(k), "shingle long, n long")
              .groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN))
    counts = store(counts, "often")
    least, total = OFTEN, 0
    for row in counts.groupBy("n").agg(F.count("*").alias("of")).orderBy(F.desc("n")).collect():
        total += row["of"]
        if total > FREQUENT:
            least = row["n"] + 1
            break
    found = counts.where(F.col("n") >= least).select("shingle").toArrow().column(0).to_numpy()
    discard(counts)
    return np.sort(found.view(np.uint64))


def _set_rows(k: int, num: int, den: int, frequent: np.ndarray):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()),
                        ("lead", pa.int64()), ("sketch", pa.binary()), *((f"keys_{i}", pa.list_(pa.int64())) for i in range(ROUNDS))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(k)
        seen: set = set()
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                s = shingles(text)
                h = [int(np.add.reduce(_mix(s + c)).astype(np.int64)) if len(s) else 0 for c in (_C[3], _C[4])]
                if not len(s) or doc_id is None:
                    rows.append((doc_id, len(s), *h, 0, None, *[[]] * ROUNDS))
                    continue
                keys = [[]] * ROUNDS
                if (h[0], h[1]) not in seen:                        # copies that this task has seen add no keys
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add((h[0], h[1]))
                    keys = in_rounds(part_keys(s, num, den, frequent))
                rows.append((doc_id, len(s), *h, int(s[0] >> np.uint64(1)), bitmap(s, sketch_bits(_class(len(s)) + 1)).tobytes(), *keys))
            cols = list(zip(*rows)) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
    return run


_MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("need", pa.int64()), ("key", pa.int64())])


def _met(num: int, den: int):
    """Rows ``key, set, size`` sorted by key and set: each pair of sets under a key of up
    to ``RUN`` sets, with how many keys it needs; under a longer one each set with the
    first (``need`` is 0).  The first and last key of a partition, which may go on in
    another one, count as long and are reported too (with the key)."""
    def out(a=(), b=(), need=(), key=()) -> pa.RecordBatch:
        n = max(len(a), len(key))
        cols = [c if len(c) else [None] * n for c in (a, b, need, key)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _MET.types)], schema=_MET)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, np.int64)] * 3                          # of a key that may go on
        held, size = [], 0
        going: tuple[int, int] | None = None                       # the key of a long run that may go on, and its first set
        started = False

        def decided(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal rest, held, size, going, started
            k, d, n = (np.concatenate([r, *(h[i] for h in held)]) for i, r in enumerate(rest))
            rest, held, size = [np.empty(0, np.int64)] * 3, [], 0
            if not len(k):
                if last and going:
                    yield out(a=[going[1]], key=[going[0]])
                return
            new = np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])]
            k, d, n = k[new], d[new], n[new]
            start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            count = np.diff(np.r_[start, len(k)])
            head, long = d[start].copy(), count > RUN
            if not started:
                started, long[0] = True, True
                yield out(a=d[:1], key=k[:1])
            elif going and going[0] == k[0]:
                head[0], long[0] = going[1], True
            long[-1] |= last
            if last:
                yield out(a=head[-1:], key=k[-1:])
            going = (int(k[-1]), int(head[-1])) if long[-1] else None
            if not long[-1]:
                rest = [x[start[-1]:] for x in (k, d, n)]
                count[-1] = 0                                       # left for later
            of = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(k)]))
            star = long[of] & (d != head[of])
            if star.any():
                pairs = np.unique(np.stack([d[star], head[of[star]]], 1), axis=0)
                yield out(pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64))
            few = ~long[of] & (count[of] > 1)
            of, d, n = of[few], d[few], n[few]
            for j in range(1, RUN):
                at = np.flatnonzero(of[j:] == of[:-j])
                if not len(at):
                    break
                need = needed(n[at], n[at + j], num, den)
                at, need = at[need > 0], need[need > 0]
                if len(at):
                    yield out(d[at], d[at + j], need)

        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for i in range(3)])
            size += batch.num_rows
            if size >= _ROWS:
                yield from decided(False)
        yield from decided(True)
    return run


def _candidate_links(sets: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b``: sets (by ``h1``) that share as many keys as linked ones must, or that
    stand under one long key, each linked to one of them.

    Rows are range-sorted by (key, set): a key held by very many sets is dealt
    over several partitions, whose pieces are joined by their ends.  The ranges
    of keys come one after the other, so that the shared disks hold the shuffle
    of one of them at a time.
    """
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found, met = [], []
    for i in range(ROUNDS):
        rows = sets.select(F.explode(f"keys_{i}").alias("key"), "h1", "n_shingles")
        ordered = rows.repartitionByRange(-(-n // ROUNDS), "key", "h1").sortWithinPartitions("key", "h1")
        near = store(ordered.mapInArrow(_met(num, den), "a long, b long, need long, key long"), "near")
        ends = near.where("key is not null").select("key", "a")    # two rows for each partition
        across = ends.join(ends.groupBy("key").agg(F.min("a").alias("b")), "key").where("a <> b").select("a", "b")
        found.append(near.where("need = 0").select("a", "b").union(across))
        met.append(near.where("need > 0").select("a", "b", "need"))
    pairs = reduce(DataFrame.union, met).groupBy("a", "b", "need").agg(F.count("*").alias("keys")).where("keys >= need")
    return reduce(DataFrame.union, found).union(pairs.select("a", "b"))


class SignatureTree:
    """A hierarchy over members in the given order (similar ones are
    neighbours): OR of their bitmaps, the range of their sizes, and the largest
    number of tokens that share a bit."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, native: np.ndarray):
        slack = sizes - np.bitwise_count(maps).sum(1).astype(np.int64)
        self.levels = [(maps, sizes, sizes, slack)]
        self.sides = [(native, ~native)]                           # nodes with a native, and with another
        while len(self.levels[-1][0]) > 1:
            m, lo, hi, sl = self.levels[-1]
            cut = np.arange(0, len(m), FAN)
            self.levels.append((np.bitwise_or.reduceat(m, cut, axis=0), np.minimum.reduceat(lo, cut),
                                np.maximum.reduceat(hi, cut), np.maximum.reduceat(sl, cut)))
            self.sides.append(tuple(np.logical_or.reduceat(x, cut) for x in self.sides[-1]))

    def meet(self, level: int, a: int, b: np.ndarray, cross: bool) -> np.ndarray:
        """Which nodes of ``b`` hold members to be compared with some of node ``a``."""
        native, other = self.sides[level]
        return (native[a] & other[b]) | (other[a] & native[b]) | ((native[a] & native[b]) & (not cross))

    def possible(self, level: int, a: int, b: np.ndarray, num: int, den: int) -> np.ndarray:
        """Which nodes of ``b`` could hold a partner of a member of node ``a``."""
        m, lo, hi, slack = self.levels[level]
        shared = np.bitwise_count(m[b] & m[a]).sum(1).astype(np.int64)
        most = np.minimum(np.minimum(hi[a], hi[b]), shared + np.minimum(slack[a], slack[b]))
        return most * (num + den) >= num * (lo[a] + lo[b])

    def spanning(self, num: int, den: int, guest: np.ndarray, same=None, cross: bool = False) -> list[tuple[int, int]]:
        """Pairs of members that connect all that the pairs passing the bound
        (and ``same(i, j)``, if given) connect.  Left out are pairs of two
        members of other blocks, and of two guests of the size class."""
        n_members = len(self.levels[0][0])
        root = list(range(n_members))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        out = []
        todo = [(len(self.levels) - 1, 0, np.zeros(1, np.int64))] if n_members else []
        while todo:
            level, a, near = todo.pop()
            if level == 0:
                for b in near.tolist():
                    if a < b and not (guest[a] and guest[b]) and find(a) != find(b) and (same is None or same(a, b)):
                        root[find(b)] = find(a)
                        out.append((a, b))
                continue
            n = len(self.levels[level - 1][0])
            below = (near[:, None] * FAN + np.arange(FAN)).ravel()
            below = below[below < n]
            for child in range(a * FAN, min(n, (a + 1) * FAN)):
                others = below[below >= child]
                others = others[self.meet(level - 1, child, others, cross)]
                if len(others):
                    fit = others[self.possible(level - 1, child, others, num, den)]
                    if len(fit):
                        todo.append((level - 1, child, fit))
        return out


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs(ids: list[int], found: list[tuple[int, int]]) -> pa.Table:
    pairs = sorted({(max(ids[i], ids[j]), min(ids[i], ids[j])) for i, j in found if ids[i] != ids[j]})
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())}, schema=_PAIR)


def _order(sizes: np.ndarray, lead: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Sets of one side, of like size, and among them those with one smallest hash, are neighbours."""
    return np.lexsort((sizes, lead, np.log2(np.maximum(sizes, 1)) // 0.25, side))


def _bounded(num: int, den: int):
    """Step 3 for one block: pairs that the bitmaps do not rule out."""
    def run(table: pa.Table) -> pa.Table:
        sizes = table.column("n_shingles").to_numpy()
        blobs = table.column("sketch").to_pylist()
        words = min(sketch_bits(table.column("size_class")[0].as_py()) // 64, min(map(len, blobs)) // 8)
        cross = table.column("cross")[0].as_py()
        order = _order(sizes, table.column("lead").to_numpy(), np.array(table.column("native").to_pylist(), bool) & cross)
        maps = np.stack([folded(np.frombuffer(blobs[i], np.uint64), words) for i in order])
        native, guest = (np.array(table.column(c).to_pylist(), bool)[order] for c in ("native", "guest"))
        ids = table.column("doc_id").to_pylist()
        return _pairs([ids[i] for i in order], SignatureTree(maps, sizes[order], native).spanning(num, den, guest, cross=cross))
    return run


def _exact(k: int, num: int, den: int):
    """Step 4 for one block: links found by comparing sets."""
    def run(table: pa.Table) -> pa.Table:
        shingles = Shingles(k)
        sets = [shingles(t) for t in table.column("text").to_pylist()]
        ids, native = table.column("doc_id").to_pylist(), np.array(table.column("native").to_pylist(), bool)
        cross = table.column("cross")[0].as_py()
        keep = [i for i, s in enumerate(sets) if len(s)]
        if not keep:
            return _pairs([], [])
        sizes = np.array([len(sets[i]) for i in keep])
        keep = [keep[i] for i in _order(sizes, np.array([sets[i][0] for i in keep]), native[keep] & cross)]
        sizes = np.array([len(sets[i]) for i in keep])
        bits = sketch_bits(_class(int(sizes.max())))
        while bits > 4096 and bits // 8 * len(keep) > MAP_BYTES:           # fewer bits prune less; the result is the same
            bits //= 2
        tree = SignatureTree(np.stack([bitmap(sets[i], bits) for i in keep]), sizes, native[keep])
        found = tree.spanning(num, den, np.zeros(len(keep), bool), lambda i, j: links(sets[keep[i]], sets[keep[j]], num, den), cross)
        named = _pairs([ids[i] for i in keep], found)
        if len(sets) > 200:
            del sets, tree
            release()
        return named
    return run


def _near_size(num: int, den: int):
    """A number of the size column; sets that can link have equal or neighbouring ones."""
    n = F.col("n_shingles")
    return F.floor(F.log(n.cast("double")) / F.lit(1.0001 * math.log(den / num))) if den > num else n


def _connected(members: DataFrame, payload: DataFrame, decide, block: int, on: list[str], num: int, den: int) -> DataFrame:
    """Pairs that connect what ``decide`` connects in each group ``(doc_id, grp, n_shingles, members, shingles)``.

    A group of up to ``block`` members (and 500 shingles for each) is one
    task.  A larger one is cut into blocks by hash; in the first round each block is decided together with
    about ``CENTRES`` members of the whole group (which connects most copies of
    one text).  In the second, members of the group's largest component need not
    be compared again; the others are.  Both kinds are cut by size and then into
    blocks by hash, and a task gets two blocks whose sizes allow links (not two of the
    largest component), or one with itself.  So no task holds more than two
    blocks; if most members stay apart, rows are sent once for each block of like size.
    """
    def blocks(n: str, shingles: str):
        return F.ceil(F.greatest(F.col(n) / block, F.col(shingles) / (500 * block))).cast("int")

    def own(n: str):
        return F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col(n)).cast("int")

    rows = members.withColumn("blocks", blocks("members", "shingles"))
    rows = store(rows.withColumn("own", own("blocks")), "blocks")
    all_blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    centre = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("members")) < CENTRES)
    extra = [c for c in members.columns if c not in ("doc_id", "grp", "members", "shingles")]

    def decided(sent: DataFrame) -> DataFrame:
        """``one, two``: the task's blocks; a row is native in block ``one``."""
        sent = store(sent.select("grp", "doc_id", *extra, "one", "two", "native"), "sent")
        full = payload.join(sized(sent), on).withColumn("cross", F.col("one") != F.col("two"))
        return store(full.groupBy("grp", "one", "two").applyInArrow(decide, "a long, b long"), "pairs")

    to = rows.withColumn("at", F.explode(F.when(centre, all_blocks).otherwise(F.array("own"))))
    first = decided(to.withColumn("one", F.col("at").cast("string")).withColumn("two", F.col("one")).withColumn("native", F.col("at") == F.col("own")))
    large = rows.where("blocks > 1")
    if large.isEmpty():
        return first
    parts = components(first)
    placed = large.join(parts, large["doc_id"] == parts["node"], "left").withColumn("part", F.coalesce("component", "doc_id"))
    sizes = placed.groupBy("grp", "part").agg(F.count("*").alias("n"))
    main = sizes.groupBy("grp").agg(F.max_by("part", F.struct("n", F.col("part"))).alias("main"))
    placed = store(placed.join(main, "grp").select("grp", "doc_id", *extra, (F.col("part") == F.col("main")).alias("linked")), "placed")
    # where the others fit one block, there is nothing to save by their sizes
    apart = placed.where(~F.col("linked")).groupBy("grp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("sh"))
    placed = placed.join(apart.select("grp", (blocks("n", "sh") > 1).alias("by_size")), "grp").withColumn(
        "like", F.when(F.col("by_size"), _near_size(num, den)).otherwise(F.lit(0)))
    cuts = store(placed.groupBy("grp", "linked", "like").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("sh"))
                 .select("grp", "linked", "like", blocks("n", "sh").alias("n_blocks")), "cuts")
    others = cuts.select("grp", F.col("linked").alias("o_linked"), F.col("like").alias("o_like"), F.col("n_blocks").alias("o_blocks"))
    mine = F.concat_ws(":", "like", "linked", own("n_blocks"))
    again = (placed.join(cuts, ["grp", "linked", "like"]).withColumn("mine", mine)
             .withColumn("o_like", F.explode(F.when(F.col("by_size"), F.array(F.col("like") - 1, F.col("like"), F.col("like") + 1))
                                              .otherwise(F.array("like"))))
             .join(others, ["grp", "o_like"]).where(~(F.col("linked") & F.col("o_linked")))
             .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("o_blocks") - 1)))
             .withColumn("other", F.concat_ws(":", "o_like", "o_linked", "chunk"))
             .withColumn("one", F.least("mine", "other")).withColumn("two", F.greatest("mine", "other"))
             .withColumn("native", F.col("mine") == F.col("one")))
    return first.union(decided(again))


def _counted(grouped: DataFrame) -> DataFrame:
    """With each group's members and shingles; groups of one are left out."""
    sizes = grouped.groupBy("grp").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("shingles")).where("members > 1")
    return grouped.join(sizes, "grp")


def _in_classes(grouped: DataFrame, num: int, den: int) -> DataFrame:
    """Groups cut by size class.  A set whose partners can be in higher classes
    is a guest there."""
    def class_of(n):
        return F.aggregate(F.array(*[F.lit(x) for x in SIZES]), F.lit(0), lambda acc, x: acc + F.when(n > x, 1).otherwise(0))

    n = F.col("n_shingles")
    own = grouped.withColumn("first_class", class_of(n)).withColumn("last_class", class_of(F.floor(n * den / num)))
    cut = own.select("doc_id", "n_shingles", "grp", "first_class", F.explode(F.sequence("first_class", "last_class")).alias("size_class"))
    return _counted(cut.select("doc_id", "n_shingles", F.xxhash64("grp", "size_class").alias("grp"), "size_class",
                               (F.col("size_class") > F.col("first_class")).alias("guest")))


def jaccard_groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text",
                   block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    Words are runs without white space (0x20, 0x09-0x0D), A-Z in lower case; a
    set holds the distinct ``k``-word shingles, or the whole sequence if it is
    shorter.  Rows link when den * |both| >= num * |either|.  Null and empty
    texts have empty sets and link with nothing.  ``component_id`` is the
    smallest id reachable.  Repeated ids are one node (rows keep their own
    ``n_shingles``); rows with a null id link with nothing and have a null
    component.  An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = store(texts.mapInArrow(_set_rows(k, num, den, _frequent(texts, k)), "doc_id long, n_shingles long, h1 long, h2 long, lead long, sketch binary, "
                                  + ", ".join(f"keys_{i} array<long>" for i in range(ROUNDS))), "sets")
    # what is large is deleted as soon as nothing reads it any more
    rows = store(sets.select("doc_id", "n_shingles", "h1", "h2"), "rows")
    real = "n_shingles > 0 and doc_id is not null"
    shared = _candidate_links(sets.where(real), num, den)
    near = components(shared)
    discard(shared)
    # one document stands for each set; copies of it take part in nothing but the last join
    firsts = store(sets.where(real).groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.first("lead").alias("lead"),
                                                                          F.first("sketch").alias("sketch")), "firsts")
    discard(sets)
    grouped = firsts.join(near, F.col("h1") == F.col("node")).select("doc_id", "n_shingles", F.col("component").alias("grp"))
    sketches = firsts.select("doc_id", "n_shingles", "lead", "sketch")
    bounded = components(_connected(_in_classes(grouped, num, den), sketches, _bounded(num, den), block, ["doc_id", "n_shingles"], num, den))
    members = firsts.join(bounded, F.col("doc_id") == F.col("node")).select("doc_id", "n_shingles", F.col("component").alias("grp"))
    exact = _connected(_counted(members), texts, _exact(k, num, den), block, ["doc_id"], num, den)
    # a repeated id is one node, so its sets are linked through it
    final = store(components(exact.union(_repeated_ids(rows.where(real), firsts))), "final")
    named = firsts.join(final, F.col("doc_id") == F.col("node"), "left").select(
        F.col("n_shingles").alias("n"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.coalesce("component", "doc_id").alias("of_set"))
    named = store(named, "named")
    discard(firsts)
    out = rows.join(
        named, (F.col("n_shingles") == F.col("n")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_set", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


def _repeated_ids(real: DataFrame, firsts: DataFrame) -> DataFrame:
    """Links between the documents that stand for the different sets of one id."""
    ids = store(real.groupBy("doc_id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("doc_id"), "repeated")
    several = real.select("doc_id", "n_shingles", "h1", "h2").join(sized(ids), "doc_id").distinct()
    keyed = firsts.select("n_shingles", "h1", "h2", F.col("doc_id").alias("rep"))
    a = several.join(keyed, ["n_shingles", "h1", "h2"]).select("doc_id", F.col("rep").alias("a"))
    return a.groupBy("doc_id").agg(F.min("a").alias("b")).join(a, "doc_id").where("a <> b").select("a", "b")


#: Rows without an id are named by their text, above all ids of documents.
_UNNAMED = 1 << 62


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each group of ``docs``: the document with the smallest id.

    Rows that repeat an id are one document; the row with the smallest hash of its
    values stays.  Rows without an id take part by their text: they stay only if
    no document with an id is in their group, and then one of them does; those
    without words are linked with nothing and stay.  All columns stay as they are."""
    named = F.when(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(_UNNAMED) + F.pmod(F.xxhash64(text_col), F.lit(_UNNAMED >> 1)))
    keyed = docs.withColumn("__key", F.coalesce(F.col(id_col).cast("long"), named))
    groups = store(jaccard_groups(keyed.select("__key", text_col), id_col="__key", text_col=text_col, **how).where("doc_id is not null")
                   .select("doc_id", "component_id"), "groups")
    drop = store(groups.where("component_id <> doc_id").select(F.col("doc_id").alias("__drop")).distinct(), "drop")
    kept = keyed.join(sized(drop), F.col("__key") == F.col("__drop"), "left_anti")
    again = store(groups.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__again"))
                  .join(drop, F.col("__again") == F.col("__drop"), "left_anti"), "again")
    if again.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(sized(again), F.col("__key") == F.col("__again"), "left_anti").select(*docs.columns)
    several = kept.join(sized(again), F.col("__key") == F.col("__again"), "left_semi")
    one = several.groupBy("__key").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("one"))
    return once.unionByName(one.select("one.*"))
