"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over a window of bytes cuts texts into chunks at places that
depend on the content only, so passages, lines and copies shared by documents
give the same chunks wherever they stand.  A worker encodes each distinct chunk
once and keeps the result in a bounded cache.  A cut may fall inside a word, so
chunk joins are repaired: what stands between the last white space before a cut
and the first one after it is joined and encoded anew.  White space always ends
a word for the tokenizer, hence the repaired sequence agrees exactly with an
encoding of the whole text.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, functions as F

from .common import map_rows

WINDOW = 16
#: A cut follows where this many bits of the mixed window hash are 0: chunks of 512 bytes on average.
CUT_BITS = 9
#: Cache bounds of a worker.  An executor runs a worker for each core beside its
#: heap, so they count as often.
CHUNK_CACHE_BYTES = 8 << 20
WORD_CACHE = 80_000
WORD_CHARS = 128
_GEAR = np.random.default_rng(7).integers(1, 1 << 32, 256, dtype=np.uint32)


def cuts(data: bytes) -> list[int]:
    """Chunk ends (the last is ``len(data)``); never inside a UTF-8 character."""
    n = len(data)
    if n <= WINDOW:
        return [n]
    raw = np.frombuffer(data, np.uint8)
    total = np.cumsum(_GEAR[raw], dtype=np.uint32)
    rolled = total[WINDOW:] - total[:-WINDOW]          # over raw[i+1 .. i+WINDOW]
    mixed = (rolled * np.uint32(2654435761)) >> np.uint32(32 - CUT_BITS)
    at = np.flatnonzero(mixed == 0) + WINDOW + 1
    at = at[at < n]
    at = at[(raw[at] & 0xC0) != 0x80]
    return [*at.tolist(), n]


@lru_cache(maxsize=2)
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _split_pattern(path: str) -> str:
    """The pattern by which the tokenizer cuts words, from its file; only this kind of pipeline is known here."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kinds = [n["type"] for n in spec["normalizer"]["normalizers"]] + [p["type"] for p in spec["pre_tokenizer"]["pretokenizers"]]
    if kinds != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] or spec["pre_tokenizer"]["pretokenizers"][1]["add_prefix_space"]:
        raise ValueError(f"unknown tokenizer pipeline {kinds}")
    return spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]


def _byte_letters() -> dict[int, str]:
    """The visible character that byte-level vocabularies use for a byte: itself
    if printable, else the next free one from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Words of these characters need no normalisation but lower case; others go through the whole library.
_PLAIN = re.compile(r"[!-~\u00c0-\u012f\u0131-\u017f]+")
_LETTERS = str.maketrans(_byte_letters())
_UINT32 = next(c for c in "IL" if array(c).itemsize == 4)


def _packed(ids: list[int]) -> bytes:
    """As little-endian unsigned 32-bit integers; for short lists much faster than an array of numpy."""
    out = array(_UINT32, ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class ChunkEncoder:
    """Encodes texts to ``(ids as little-endian uint32 bytes, decoded text)``."""

    def __init__(self, path: str):
        self.tok = load_tokenizer(path)
        if self.tok.decoder is not None:
            raise ValueError("decoding by parts needs a tokenizer without a decoder (tokens joined by one space)")
        self.model = self.tok.model
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.tokens = [""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.tokens[i] = t
        special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) if special else r"(?!)")
        pattern = _split_pattern(path)
        self.pieces = regex.compile(pattern)
        self.runs = r"|[\p{L}]+|" in pattern                       # letters alone match this branch only
        # words and their pieces; what the last full cache held is looked up once more, so frequent ones stay
        self.ids: dict[bytes, bytes] = {}
        self.last_ids: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.last_parts: dict[str, bytes] = {}
        self.chunks: dict[bytes, tuple] = {}
        self.held = 0
        self.reused = self.encoded = 0

    def _part(self, piece: str) -> bytes:
        got = self.parts.get(piece)
        if got is None:
            got = self.last_parts.get(piece)
            if got is None:
                shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_LETTERS)
                got = _packed([t.id for t in self.model.tokenize(shown)])
            if len(self.parts) >= WORD_CACHE:
                self.last_parts, self.parts = self.parts, {}
            if len(piece) <= WORD_CHARS:
                self.parts[piece] = got
        return got

    def word(self, data: bytes) -> bytes:
        """Ids of one word.  Plain words are cut by the tokenizer's own pattern and
        merged by its model, piece by piece (letters alone are one piece); all
        others take its whole pipeline."""
        word = data.decode()
        if _PLAIN.fullmatch(word) and not self.special.search(word):
            word = word.lower()
            return self._part(word) if self.runs and word.isalpha() else b"".join(map(self._part, self.pieces.findall(word)))
        return _packed(self.tok.encode(word, add_special_tokens=False).ids)

    def words(self, words: list[bytes]) -> bytes:
        known = self.ids
        new = set(words).difference(known)
        if not new:
            return b"".join(map(known.__getitem__, words))
        if len(known) + len(new) > WORD_CACHE:
            self.last_ids, self.ids = known, {}
            known, new = self.ids, set(words)
        last, long = self.last_ids, {}
        for w in new:
            (known if len(w) <= WORD_CHARS else long)[w] = last[w] if w in last else self.word(w)
        return b"".join([long[w] if w in long else known[w] for w in words])

    def chunk(self, data: bytes) -> tuple:
        """``(head, ids, tail)``; head and tail are the parts of words at the chunk's
        ends.  A chunk without white space is all head, and has no ids."""
        hit = self.chunks.get(data)
        if hit is not None:
            self.reused += 1
            return hit
        self.encoded += 1
        words = data.split()
        if len(words) == 1 and len(words[0]) == len(data):
            out = (data, None, b"")
        else:
            head = b"" if data[:1].isspace() else words.pop(0)
            tail = words.pop() if words and not data[-1:].isspace() else b""
            out = (head, self.words(words), tail)
        size = 2 * len(data) + len(out[1] or b"") + 300
        if self.held + size > CHUNK_CACHE_BYTES:
            self.chunks.clear()
            self.held = 0
        if size <= CHUNK_CACHE_BYTES // 8:
            self.chunks[data] = out
            self.held += size
        return out

    def encode(self, text: str | None) -> tuple[bytes, str]:
        if not text:
            return b"", ""
        data = text.encode()
        ids, open_word, start = [], [], 0
        for end in cuts(data):
            head, got, tail = self.chunk(data[start:end])
            start = end
            open_word.append(head)
            if got is not None:
                ids += [self._repaired(open_word), got]
                open_word = [tail]
        ids.append(self._repaired(open_word))
        whole = b"".join(ids)
        return whole, " ".join(map(self.tokens.__getitem__, np.frombuffer(whole, "<u4").tolist()))

    def _repaired(self, parts: list[bytes]) -> bytes:
        word = b"".join(parts)
        return self.words([word]) if word else b""


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` for every row of ``docs``.

    ``ids`` holds the token ids as little-endian unsigned 32-bit integers and
    equals the tokenizers library's ``encode(text, add_special_tokens=False)``
    over the whole text; ``decoded`` equals its ``decode(ids,
    skip_special_tokens=False)``.  Null and empty texts give no ids and an
    empty text.  Rows are independent: repeated rows give repeated results, a
    null id stays null, an empty table gives no rows.  A worker holds one
    text's result and its bounded caches.
    """
    def make():
        encoder = ChunkEncoder(tokenizer_path)

        def row(doc_id, text):
            ids, shown = encoder.encode(text)
            return doc_id, len(ids) // 4, ids, shown
        return row

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(src, make, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary, decoded string")
