"""Cross-tokenizer alignment with corpus-wide counts of linked token pairs.

Two tokenizers cut the same bytes; the byte offsets where tokens of both end cut
a text into groups, and the two tokens that end together there are linked.  A
first pass over the texts aligns them and gathers how often each pair of ids is
linked.  The distinct pairs get slots by minimal perfect hashing, the counts
become dense vectors indexed by slot, and those are summed along a tree.  The
second pass aligns the texts again and looks the counts up in the vectors, each
key verified.

Pairs are dealt to shards by the second tokenizer's id, so all partners of an
id meet in one shard, and a shard holds at most one vocabulary's pairs for each
id in it.

Texts are cut into units where neither tokenizer can join what stands on both
sides; a worker aligns each distinct unit once and keeps a bounded table.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bound_batches, release, slices, store
from .perfect_hash import Table, build

SPACE = "▁"
#: Bounds of a worker's table of units: their number, and the bytes of them and their groups.
UNITS, UNIT_BYTES = 300_000, 48 << 20
#: Longer texts are aligned piece by piece (cut between units).
PIECE_CHARS = 1 << 18
#: Distinct pairs of a shard, about.
SHARD_PAIRS = 1 << 14
#: Vectors summed by one task of the tree.
FAN_IN = 8
#: Rows counted into one vector, about.
VECTOR_ROWS = 1 << 20
#: Pairs (20 bytes each) that the second pass holds in its workers; rarer pairs beyond them are joined.
HELD_PAIRS = 4_000_000

_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_STOPS = ".,;:!?"
#: No white space, control or format character by any library's notion.
_SAFE = r"[^\x00-\x20\x7f-\xa0 ᠎ -⁯　﻿]"
#: A unit is a run of blanks with the word after it.  A word that ends in an odd
#: character goes on through the next blanks; a stop after a letter begins a unit.
_UNITS = re.compile(rf"[ \n]*[{_LATIN}]++(?![^ \n{_STOPS}])|[ \n]*[^ \n]+(?:(?<!{_SAFE})[ \n]+(?:[^ \n]+|\Z))*+|[ \n]+")
_CUT = re.compile(rf"(?<={_SAFE})(?= {_SAFE})")
_FIRM = re.compile(_SAFE).match


def byte_letters() -> dict[str, int]:
    """The byte behind each visible character of a byte-level vocabulary: itself
    if printable, else in order from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """The two tokenizers, loaded from their files on the worker."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.a_bytes[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_len = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_len = np.array([len(t) for t in self.b_bytes], np.int64)
        self.cuts = self._known(a_path, [p for i, p in enumerate(pieces) if not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_byte(i))])

    @staticmethod
    def _known(a_path: str, pieces: list[str]) -> bool:
        """Whether the tokenizers are of the kind whose words the pattern knows; else texts are not cut."""
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        return (not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
                and not any(SPACE in p.lstrip(SPACE) or re.search(rf"\n|[{_LATIN}][{_STOPS}]", p) for p in pieces))

    def alone(self, unit: str) -> tuple[list[int], list[int]]:
        """Ids of a unit encoded by itself.  The second tokenizer puts a space before
        a text; what does not begin with one is encoded after a line feed, which
        never joins with anything."""
        a = self.a.encode(unit, add_special_tokens=False).ids
        if unit[:1] == " ":
            return a, self.b.encode(unit[1:])
        return a, self.b.encode("\n" + unit)[2:]

    def same(self, unit: str, a: list[int], b: list[int]) -> bool:
        data = unit.encode()
        return b"".join(map(self.a_bytes.__getitem__, a)) == data and b"".join(map(self.b_bytes.__getitem__, b)) == data


def shown(a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray) -> list[str]:
    """The groups ``a1,a2|b1`` of ids whose last members stand at ``a_at`` and ``b_at``."""
    sa, sb = list(map(str, a.tolist())), list(map(str, b.tolist()))
    out, x, y = [], 0, 0
    for i, j in zip((a_at + 1).tolist(), (b_at + 1).tolist()):
        out.append(f"{sa[x]}|{sb[y]}" if i - x == 1 == j - y else ",".join(sa[x:i]) + "|" + ",".join(sb[y:j]))
        x, y = i, j
    return out


class Units:
    """The worker's table of aligned units: numbers of tokens and groups, the
    linked pairs as keys ``a << 32 | b``, the groups as text if they are wanted,
    and how often each unit came (``times``)."""

    def __init__(self, pair: Pair, shown: bool = True):
        self.pair, self.shown = pair, shown
        self.index: dict[str, int] = {}
        self.names: list[str] = []
        self.text: list[str] = []
        self.numbers = np.zeros((1024, 3), np.int64)              # tokens a, tokens b, groups
        self.times = np.zeros(1024, np.int64)
        self.start = np.zeros(1025, np.int64)                     # of the unit's links; a link for each group
        self.links = np.zeros(4096, np.int64)
        self.bytes = 0

    def clear(self) -> None:
        """Keeps the units that came more than once, half a table of them at most."""
        n = len(self)
        stay = np.flatnonzero(self.times[:n] > 1)
        if len(stay) > UNITS // 2:
            stay = np.sort(stay[np.argsort(-self.times[stay], kind="stable")[:UNITS // 2]])
        if sum(len(self.names[i]) + len(self.text[i]) for i in stay) > UNIT_BYTES // 2:
            stay = stay[:0]
        size = np.diff(self.start[:n + 1])[stay]
        start = np.concatenate([[0], np.cumsum(size)])
        links = self.links[np.arange(start[-1]) + np.repeat(self.start[stay] - start[:-1], size)]
        self.names, self.text = [self.names[i] for i in stay], [self.text[i] for i in stay]
        self.index = {u: i for i, u in enumerate(self.names)}
        self.bytes = sum(map(len, self.names)) + sum(map(len, self.text))
        self.numbers[:len(stay)], self.start[:len(stay) + 1], self.links[:len(links)] = self.numbers[stay], start, links
        self.times[:] = 0

    def __len__(self) -> int:
        return len(self.names)

    def full(self) -> bool:
        return len(self) >= UNITS or self.bytes >= UNIT_BYTES

    def _grown(self, units: int, links: int) -> None:
        while units > len(self.numbers):
            self.numbers = np.concatenate([self.numbers, np.zeros_like(self.numbers)])
        while units > len(self.times):
            self.times = np.concatenate([self.times, np.zeros_like(self.times)])
        while units + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        while links > len(self.links):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])

    def _put(self, units: list[str], a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> None:
        """Adds units that follow one another in the ids ``a`` and ``b``; each ends at a byte of ``ends``."""
        a_end, b_end = np.cumsum(self.pair.a_len[a]), np.cumsum(self.pair.b_len[b])
        both, a_at, b_at = np.intersect1d(a_end, b_end, assume_unique=True, return_indices=True)
        last = np.searchsorted(both, ends)                        # each unit's last group
        n, at, firsts = len(self), self.start[len(self)], np.concatenate([[0], last[:-1] + 1])
        self._grown(n + len(units), at + len(both))
        self.links[at:at + len(both)] = a[a_at] << 32 | b[b_at]
        self.start[n + 1:n + 1 + len(units)] = at + last + 1
        for k, x in enumerate((a_at[last] + 1, b_at[last] + 1, last + 1)):
            self.numbers[n:n + len(units), k] = np.diff(x, prepend=0)
        if self.shown:
            groups = shown(a, b, a_at, b_at)
            text = [groups[x] if y - x == 1 else ";".join(groups[x:y]) for x, y in zip(firsts.tolist(), (last + 1).tolist())]
        else:
            text = [""] * len(units)
        self._named(units, text)

    def _named(self, units: list[str], text: list[str]) -> None:
        self.index.update(zip(units, range(len(self), len(self) + len(units))))
        self.names += units
        self.text += text
        self.bytes += sum(map(len, units)) + sum(map(len, text))

    def _bad(self, unit: str) -> None:
        """A unit whose tokens don't spell it; it has no links."""
        n = len(self)
        self._grown(n + 1, 0)
        self.start[n + 1], self.numbers[n] = self.start[n], -1
        self._named([unit], [""])

    def _one(self, unit: str) -> None:
        a, b = self.pair.alone(unit)
        if self.pair.same(unit, a, b):
            self._put([unit], np.array(a, np.int64), np.array(b, np.int64), np.array([len(unit.encode())]))
        else:
            self._bad(unit)

    def _many(self, units: list[str]) -> None:
        """Units in a row, encoded at once: a unit without a leading blank follows a line feed of its own."""
        if len(units) < 3:
            for u in units:
                self._one(u)
            return
        lead = [0 if u[0] in " \n" else 1 for u in units]
        text = " x" + "".join("\n" + u if k else u for u, k in zip(units, lead))
        a, b = self.pair.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.pair.b.encode(text[1:])
        if not self.pair.same(text, a, b):
            self._many(units[:len(units) // 2])
            self._many(units[len(units) // 2:])
            return
        a, b, lead = np.array(a, np.int64), np.array(b, np.int64), np.array(lead)
        sizes = np.array([len(u.encode()) for u in units])
        ends = np.cumsum(sizes + lead) + 2
        feeds = (ends - sizes)[lead == 1]                         # where the added line feeds end
        kept = []
        for ids, length in ((a, self.pair.a_len), (b, self.pair.b_len)):
            end = np.cumsum(length[ids])
            kept.append(ids[~np.isin(end, feeds) & (end > 2)])
        ends = np.cumsum(sizes)
        if not all(np.isin(ends, np.cumsum(length[ids])).all() for ids, length in zip(kept, (self.pair.a_len, self.pair.b_len))):
            raise ValueError("a token goes over the end of a unit")
        self._put(units, *kept, ends)

    def cut(self, text: str) -> list[str]:
        return _UNITS.findall(text) if self.pair.cuts else [text]

    def learn(self, units: set[str]) -> None:
        """Aligns the units that the table doesn't hold."""
        new = units.difference(self.index)
        odd = [u for u in new if len(u) > 1000 or not _FIRM(u[-1])]
        for u in odd:
            self._one(u)
        if new := list(new.difference(odd)):
            self._many(new)

    def codes(self, units: list[str]) -> np.ndarray:
        """The units as numbers, all of which the table holds."""
        return np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))

    def whole(self, text: str) -> np.ndarray:
        """The text as one unit: what decides where a part of it is not spelled by its tokens."""
        if text not in self.index:
            self._one(text)
        return np.array([self.index[text]])


def pieces(text: str) -> Iterator[str]:
    """The text in pieces of about ``PIECE_CHARS``, cut between units."""
    at = 0
    while len(text) - at > PIECE_CHARS and (m := _CUT.search(text, at + PIECE_CHARS)):
        yield text[at:m.start()]
        at = m.start()
    yield text[at:]


def aligned(units: Units, texts: list[str | None], flush) -> Iterator[tuple[int, np.ndarray]]:
    """``(place of the text, numbers of its units)``, a piece of a text at a time;
    texts without tokens don't come.  The numbers hold until the next is asked
    for; ``flush`` is called before the table is cleared."""
    def room() -> None:
        if units.full():
            flush()
            units.clear()

    def given(at: int, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        np.add.at(units.times, codes, 1)
        yield at, codes

    def decided(at: int, text: str) -> Iterator[tuple[int, np.ndarray]]:
        """A part of the text is not spelled by its tokens: the whole decides."""
        codes = units.whole(text)
        if units.numbers[codes[0], 0] >= 0:
            yield from given(at, codes)

    def together(group: list[tuple[int, str]]) -> Iterator[tuple[int, np.ndarray]]:
        room()
        cut = [units.cut(t) for _, t in group]
        units.learn(set().union(*cut))
        for (at, text), parts in zip(group, cut):
            codes = units.codes(parts)
            yield from decided(at, text) if (units.numbers[codes, 0] < 0).any() else given(at, codes)

    def by_piece(at: int, text: str) -> Iterator[tuple[int, np.ndarray]]:
        for dry in (True, False):                                 # looked through first, since one bad unit decides on all of it
            for piece in pieces(text):
                room()
                parts = units.cut(piece)
                units.learn(set(parts))
                codes = units.codes(parts)
                if (units.numbers[codes, 0] < 0).any():
                    yield from decided(at, text)
                    return
                if not dry:
                    yield from given(at, codes)

    group, size = [], 0
    for at, text in enumerate(texts):
        if not text:
            continue
        text = " " + text
        if len(text) > PIECE_CHARS and units.pair.cuts:
            yield from by_piece(at, text)
            continue
        group.append((at, text))
        size += len(text)
        if size >= PIECE_CHARS:
            yield from together(group)
            group, size = [], 0
    if group:
        yield from together(group)


@lru_cache(maxsize=1)
def table_of(a_path: str, b_path: str, shown: bool) -> Units:
    """One table for each worker, kept between tasks."""
    return Units(Pair(a_path, b_path), shown)


_COUNTS = pa.schema([("key", pa.int64()), ("n", pa.int64())])


def linked_pairs(texts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``key, n``: how often pairs are linked, summed as far as a task's table goes (a key may come again)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, done = table_of(a_path, b_path, False), []
        units.times[:] = 0

        def flush() -> None:
            n = len(units)
            times = np.repeat(units.times[:n], np.diff(units.start[:n + 1]))
            keys, at = np.unique(units.links[:units.start[n]][times > 0], return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, at, times[times > 0])
            done.append(pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total)], schema=_COUNTS))

        for batch in slices(batches):
            for _ in aligned(units, batch.column(0).to_pylist(), flush):
                pass
            yield from done
            done.clear()
        flush()
        yield from done
        release()

    bound_batches(texts.sparkSession)
    return texts.mapInArrow(run, "key long, n long")


def _shard(shards: int):
    return F.pmod(F.col("key").bitwiseAND(0xFFFFFFFF), F.lit(shards)).cast("int")


def count_vectors(pairs: DataFrame, shard_pairs: int = SHARD_PAIRS, vector_rows: int = VECTOR_ROWS) -> DataFrame:
    """``shard, shards, n, sizes, bits, keys, counts, best``: for each shard its perfect
    hash and, by slot, the keys, their summed counts and whether a count is the
    highest of its second id.  ``pairs`` is a stored table ``key, n``."""
    known = pairs.agg(F.approx_count_distinct("key").alias("d"), F.count("*").alias("n")).first()
    shards = max(1, -(-known["d"] // shard_pairs))
    branches = max(1, -(-known["n"] // (shards * vector_rows)))
    dealt = pairs.withColumn("shard", _shard(shards))

    def hashed(key: tuple, t: pa.Table) -> pa.Table:
        sizes, bits, keys = build(t["key"].to_numpy())
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "sizes": pa.array([sizes.tolist()], pa.list_(pa.int64())),
                         "bits": [bits.tobytes()], "keys": [keys.tobytes()]})

    hashes = store(dealt.select("shard", "key").distinct().groupBy("shard").applyInArrow(hashed, "shard int, sizes array<long>, bits binary, keys binary"), "mph")

    def counted(key: tuple, rows: pa.Table, mph: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"shard": pa.array([], pa.int32()), "branch": pa.array([], pa.int64()), "counts": pa.array([], pa.binary())})
        own = _table(mph)
        vector = np.zeros(len(own.keys), np.int64)
        keys = rows["key"].to_numpy()
        np.add.at(vector, own.slots(keys, np.zeros(len(keys), np.int64)), rows["n"].to_numpy())
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "branch": pa.array([key[1].as_py()], pa.int64()), "counts": [vector.tobytes()]})

    branch = F.pmod(F.xxhash64("key", "n"), F.lit(branches))
    vectors = (dealt.withColumn("branch", branch).groupBy("shard", "branch")
               .cogroup(hashes.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(branches - 1).cast("long"))).alias("branch"), "sizes", "bits", "keys")
                        .groupBy("shard", "branch"))
               .applyInArrow(counted, "shard int, branch long, counts binary"))

    def summed(key: tuple, t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_py(), np.int64) for v in t["counts"])
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "branch": pa.array([key[1].as_py()], pa.int64()), "counts": [total.tobytes()]})

    while branches > 1:
        branches = -(-branches // FAN_IN)
        vectors = (store(vectors, "vectors").withColumn("branch", F.floor(F.col("branch") / FAN_IN).cast("long")).groupBy("shard", "branch")
                   .applyInArrow(summed, "shard int, branch long, counts binary"))

    out = "shard int, shards int, n long, sizes array<long>, bits binary, keys binary, counts binary, best binary"
    fields = to_arrow_schema(pairs.sparkSession.createDataFrame([], out).schema)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                second, counts = np.frombuffer(r["keys"], np.int64) & 0xFFFFFFFF, np.frombuffer(r["counts"], np.int64)
                ids, at = np.unique(second, return_inverse=True)
                most = np.zeros(len(ids), np.int64)
                np.maximum.at(most, at, counts)
                r |= {"shards": shards, "n": len(counts), "best": np.packbits(counts == most[at]).tobytes()}
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in fields.names}], schema=fields)

    return hashes.join(vectors.drop("branch"), "shard").mapInArrow(marked, out)


def _table(rows: pa.Table) -> Table:
    return Table.of([(np.array(s, np.int64), np.frombuffer(b, "<u8"), np.frombuffer(k, np.int64))
                     for s, b, k in zip(rows["sizes"].to_pylist(), rows["bits"].to_pylist(), rows["keys"].to_pylist())])


def as_rows(vectors: DataFrame) -> DataFrame:
    """``key, n, best``: the vectors as a table."""
    out = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("best", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                best = np.unpackbits(np.frombuffer(r["best"], np.uint8), count=r["n"]).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["keys"], np.int64)), pa.array(np.frombuffer(r["counts"], np.int64)), pa.array(best)], schema=out)

    return vectors.select("n", "keys", "counts", "best").mapInArrow(run, "key long, n long, best boolean")


class Lookup:
    """The counts of pairs, held by a worker of the second pass."""

    def __init__(self, shards: list[dict]):
        self.hash = _table(pa.table({k: [s[k] for s in shards] for k in ("sizes", "bits", "keys")})) if shards else None
        self.counts = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(s["counts"], np.int64) for s in shards)])
        self.best = np.concatenate([np.empty(0, bool), *(np.unpackbits(np.frombuffer(s["best"], np.uint8), count=s["n"]).astype(bool) for s in shards)])
        self.row = np.full(shards[0]["shards"] if shards else 1, -1, np.int64)         # -1: no pair fell into the shard
        self.row[[s["shard"] for s in shards]] = np.arange(len(shards))

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(found, counts, best)``; what isn't found counts 0."""
        row = self.row[(keys & 0xFFFFFFFF) % len(self.row)]
        slot = np.full(len(keys), -1, np.int64)
        if self.hash is not None and (there := row >= 0).any():
            slot[there] = self.hash.slots(keys[there], row[there])
        found, counts, best = slot >= 0, np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        counts[found], best[found] = self.counts[slot[found]], self.best[slot[found]]
        return found, counts, best


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", held_pairs: int = HELD_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` for every row of ``docs``.

    The first tokenizer (a tokenizers file, byte-level) encodes a space and the
    text, the second (a sentencepiece file) the text, before which it puts a
    space itself; both without special tokens, whose strings are plain text.
    ``groups`` lists the ids as ``a1,a2|b1;a3|b2,b3``.  A link's count is how many
    links of all rows have its pair; ``n_best`` are the links whose count is the
    highest of their second id (ties included), ``count_sum`` adds the counts.

    Null and empty texts, and those that the joined tokens of either side don't
    spell, have zeros and no groups.  Repeated rows count each time and give
    repeated results, a null id stays null, an empty table gives no rows, other
    columns are not read.

    The second pass holds up to ``held_pairs`` pairs, the most frequent; links of
    rarer ones are joined by pair, of which each then has few links.
    """
    spark = docs.sparkSession
    vectors, rare = store(count_vectors(store(linked_pairs(docs.select(text_col), a_path, b_path), "links")), "counts"), None
    if (vectors.agg(F.sum("n")).first()[0] or 0) > held_pairs:
        rows = store(as_rows(vectors), "pairs")
        cut, held = None, 0
        for s in rows.groupBy("n").count().orderBy(F.desc("n")).limit(100_000).collect():
            if (held := held + s["count"]) > held_pairs:
                break
            cut = s["n"]
        rare = rows if cut is None else rows.where(F.col("n") < cut)
        # an id's highest count is among the frequent ones, or none of its counts is
        often = rows.limit(0) if cut is None else rows.where(F.col("n") >= cut)
        vectors = store(count_vectors(store(often.select("key", "n"), "often")), "counts")
    shards = [r.asDict() for r in vectors.orderBy("shard").collect()]          # held_pairs pairs at most
    lookup = spark.sparkContext.broadcast(shards)

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    if rare is not None:
        schema += ", row long, rare array<struct<key: long, times: long>>"
    out, with_rare = to_arrow_schema(spark.createDataFrame([], schema).schema), rare is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, held = table_of(a_path, b_path, True), Lookup(lookup.value)
        best = sums = None
        missing: dict[int, list[int]] = {}
        known = 0

        def flush() -> None:
            nonlocal best, sums, known
            best, sums, known = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
            missing.clear()

        def grow() -> None:
            """Looks up the links of units that came since."""
            nonlocal best, sums, known
            n = len(units)
            if n > known:
                keys = units.links[units.start[known]:units.start[n]]
                found, counts, top = held.of(keys)
                at = np.repeat(np.arange(n - known), np.diff(units.start[known:n + 1]))
                add_best, add_sum = np.zeros(n - known, np.int64), np.zeros(n - known, np.int64)
                np.add.at(add_best, at, top)
                np.add.at(add_sum, at, counts)
                for u, k in zip(at[~found].tolist(), keys[~found].tolist()):
                    missing.setdefault(known + u, []).append(k)
                best, sums, known = np.concatenate([best, add_best]), np.concatenate([sums, add_sum]), n

        flush()
        part, seen = TaskContext.get().partitionId() << 40, 0
        for batch in slices(batches):
            ids = batch.column(0).to_pylist()
            numbers, texts, rests = np.zeros((len(ids), 5), np.int64), [""] * len(ids), [{} for _ in ids]
            for row, codes in aligned(units, batch.column(1).to_pylist(), flush):
                grow()
                numbers[row, :3] += units.numbers[codes].sum(axis=0)
                numbers[row, 3:] += best[codes].sum(), sums[codes].sum()
                groups = ";".join(map(units.text.__getitem__, codes.tolist()))
                texts[row] = f"{texts[row]};{groups}" if texts[row] else groups
                if missing:
                    for u in codes[np.isin(codes, list(missing))].tolist():
                        for k in missing[u]:
                            rests[row][k] = rests[row].get(k, 0) + 1
            a, b, g, n_best, total = numbers.T
            columns = [ids, a, b, g, g, n_best, total, texts]
            if with_rare:
                columns += [np.arange(part + seen, part + seen + len(ids)), [[{"key": k, "times": v} for k, v in r.items()] for r in rests]]
                seen += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, out.types)], schema=out)

    bound_batches(spark)
    found = src.mapInArrow(run, schema)
    return found if rare is None else _with_rare(store(found, "aligned"), rare)


def _with_rare(found: DataFrame, rare: DataFrame) -> DataFrame:
    """Adds the counts of the links that the workers didn't hold."""
    more = (found.select("row", F.explode("rare").alias("r")).select("row", "r.key", "r.times").join(rare, "key").groupBy("row")
            .agg(F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best")))
    return (found.drop("rare").join(more, "row", "left")
            .withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0)))
            .withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).drop("row", "more_best", "more_sum"))
