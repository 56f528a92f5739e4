"""Minimal perfect hash tables of 64-bit keys, built shard by shard.

A shard's keys are hashed into a bit field twice as large as their number; the
keys that land alone set their bit, the others go on to the next field with
another hash, until none is left.  A key's slot is the number of bits set
before its own, so n keys take the slots 0 to n-1 and about three bits each.
A key that was never put in gets some slot too (or none): the caller compares
it with the key kept in that slot.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

GAMMA = 2.0
MAX_LEVELS = 64


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A bijective 64-bit mix of ``keys``, another one for each seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(words of each level, bit fields as 64-bit words, the keys in the order of their slots)`` of distinct keys."""
    left, sizes, fields, placed = np.asarray(keys, np.int64), [], [], []
    while len(left):
        if len(sizes) == MAX_LEVELS:
            raise ValueError("a perfect hash needs distinct keys")
        words = max(1, int(np.ceil(GAMMA * len(left) / 64)))
        at = (mixed(left, len(sizes)) % np.uint64(64 * words)).astype(np.int64)
        hits = np.bincount(at, minlength=64 * words)
        alone = hits[at] == 1
        fields.append(np.packbits(hits == 1, bitorder="little").view("<u8"))
        sizes.append(words)
        placed.append(left[alone][np.argsort(at[alone])])
        left = left[~alone]
    empty = np.empty(0, np.int64)
    return np.array(sizes, np.int64), np.concatenate([np.empty(0, "<u8"), *fields]), np.concatenate([empty, *placed])


@dataclass
class Table:
    """Shards side by side.  Slots run through the shards in their given order."""
    sizes: np.ndarray       # shard x level: words
    starts: np.ndarray      # shard x level: first word
    words: np.ndarray
    before: np.ndarray      # bits set before each word
    keys: np.ndarray        # by slot

    @staticmethod
    def of(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> "Table":
        levels = max((len(s[0]) for s in shards), default=0)
        sizes = np.zeros((len(shards), levels), np.int64)
        for i, s in enumerate(shards):
            sizes[i, :len(s[0])] = s[0]
        ends = np.cumsum(sizes.ravel()).reshape(sizes.shape)
        words = np.concatenate([np.empty(0, np.uint64), *(s[1] for s in shards)])
        ones = np.cumsum(np.bitwise_count(words), dtype=np.int64)
        return Table(sizes, ends - sizes, words, ones - np.bitwise_count(words), np.concatenate([np.empty(0, np.int64), *(s[2] for s in shards)]))

    def slots(self, keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for keys that are not in the table (verified against the kept key)."""
        out = np.full(len(keys), -1, np.int64)
        at = np.arange(len(keys))
        for level in range(self.sizes.shape[1]):
            size = self.sizes[shard[at], level]
            at = at[size > 0]
            if not len(at):
                break
            bit = (mixed(keys[at], level) % (64 * size[size > 0]).astype(np.uint64)).astype(np.int64)
            word, low = self.starts[shard[at], level] + (bit >> 6), (bit & 63).astype(np.uint64)
            value = self.words[word]
            hit = ((value >> low) & np.uint64(1)).astype(bool)
            below = value[hit] & ((np.uint64(1) << low[hit]) - np.uint64(1))
            out[at[hit]] = self.before[word[hit]] + np.bitwise_count(below)
            at = at[~hit]
        found = np.flatnonzero(out >= 0)
        wrong = found[self.keys[out[found]] != keys[found]]
        out[wrong] = -1
        return out
