"""Token counts by heap-and-linked-list byte-pair merging.

The count is the number of initial symbols minus the number of merges; no
token identifiers are produced.  Vocabulary files are read on the workers from
the path given (a parameter; nothing is copied or trained).
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F

from .common import map_rows

SPACE = "▁"
#: Bounds the worker's memory: counts of this many distinct words are kept.
CACHE_WORDS = 500_000
#: Longer stretches without white space are counted but not kept.
CACHE_CHARS = 200


@lru_cache(maxsize=2)
def load_pieces(path: str) -> dict[str, float]:
    """Mergeable pieces and their scores from a sentencepiece BPE model."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}


def merged_count(symbols: str, scores: dict[str, float]) -> int:
    """Tokens of one stretch: pop the best adjacent pair (highest score, then
    leftmost) from a heap, splice it in a doubly linked list, push the two new
    pairs; stale heap entries are skipped.  A character outside the vocabulary
    counts as its UTF-8 bytes."""
    n = len(symbols)
    count = sum(1 if c in scores else len(c.encode()) for c in symbols)
    if n < 2:
        return count
    text: list[str | None] = list(symbols)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list[tuple[float, int, int]] = []

    def push(i: int, j: int) -> None:
        pair = text[i] + text[j]
        score = scores.get(pair)
        if score is not None:
            heapq.heappush(heap, (-score, i, len(pair)))

    for i in range(n - 1):
        push(i, i + 1)
    while heap:
        _, i, size = heapq.heappop(heap)
        if text[i] is None or (j := right[i]) < 0 or len(text[i]) + len(text[j]) != size:
            continue
        text[i] += text[j]
        text[j] = None
        right[i] = k = right[j]
        if k >= 0:
            left[k] = i
            push(i, k)
        if left[i] >= 0:
            push(left[i], i)
        count -= 1
    return count


def boundary_pattern(scores: dict[str, float]) -> re.Pattern:
    """Stretches that merges can't cross.  A word with its leading spaces is
    one if no piece has a space after another character; a line feed always is
    one if no piece holds it."""
    if any(SPACE in p.lstrip(SPACE) for p in scores) or any("\n" in p for p in scores):
        return re.compile(r".+", re.S)
    return re.compile(rf"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


def make_counter(path: str):
    scores = load_pieces(path)
    split = boundary_pattern(scores).findall
    known: dict[str, int] = {}

    def count(text: str | None) -> int:
        if not text:
            return 0
        words = split(SPACE + text.replace(" ", SPACE))
        new = set(words).difference(known)
        if not new:
            return sum(map(known.__getitem__, words))
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = set(words)
        fresh = {w: merged_count(w, scores) for w in new}
        known.update((w, c) for w, c in fresh.items() if len(w) <= CACHE_CHARS)
        return sum(fresh[w] if w in fresh else known[w] for w in words)

    return count


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    ``n_tokens`` equals the sentencepiece library's ``len(encode(text))`` for a
    BPE model with byte fallback, dummy prefix and no other normalisation; no
    begin or end tokens; texts that spell special tokens are ordinary text.
    Null and empty texts have 0 bytes and 0 tokens.  Rows are independent:
    repeated rows give repeated results, a null id stays null, an empty table
    gives no rows.  Memory is bounded by one text and the word cache.
    """
    def make():
        count = make_counter(model_path)

        def row(doc_id, n_bytes, text):
            n = count(text)
            return doc_id, n_bytes, n, n > limit
        return row

    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
                      F.col(text_col).alias("text"))
    return map_rows(src, make, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
