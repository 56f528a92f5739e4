"""Brute-force versions and small fixtures shared by the operator tests."""
from __future__ import annotations

import random
import re

WORDS = [f"w{i}" for i in range(400)]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(text: str, seed: int, share: float) -> str:
    """The text with a share of its words replaced."""
    r = random.Random(seed)
    words = text.split(" ")
    for i in r.sample(range(len(words)), max(1, int(share * len(words)))):
        words[i] = f"x{r.randrange(10_000)}"
    return " ".join(words)


def smallest_reachable(nodes, links) -> dict:
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(text, k) -> set:
    words = [w for w in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return set()
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)}


def jaccard_components(docs, k, num, den):
    """``{doc_id: component}`` by comparing all pairs of ``(doc_id, text)``."""
    sets = [(i, shingle_set(t, k)) for i, t in docs if i is not None]
    links = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if s and t and den * len(s & t) >= num * len(s | t)]
    return smallest_reachable({i for i, _ in sets}, links)


EDGE_DOCS = [(1, None), (2, ""), (3, "   "), (4, "one"), (5, "one"), (6, "a b c"), (7, "A B\tc"), (7, "a b c"), (None, "a b c"), (8, "x " * 60_000)]
EDGE_SCHEMA = "doc_id long, text string"


def with_clashes(df):
    """Extra columns named like the operators' results and helpers."""
    from pyspark.sql import functions as F
    for c in ("n_tokens", "spans", "blob", "key", "node", "component", "size", "shard", "label", "hash", "at", "item_id", "a", "b"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit("clash"))
    return df
