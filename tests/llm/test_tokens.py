"""Token counts and the codec against the libraries themselves."""
import numpy as np
import pandas as pd
import pytest

from ledgerlens.llm import bpe_codec, queries, token_counts

from ..conftest import SF_SMALL
from .helpers import EDGE_DOCS, EDGE_SCHEMA, with_clashes

TEXTS = ["", " ", "a  b", " x  ", "\n\n a", "▁a\u0000 é　ﬁ", "<s> </s> <unk> <0x0A>", "x<|endoftext|>y <|startoftext|>", "I'm don't WE'LL",
         "ΑΣ ΟΔΟΣ.", "\x1c a\x1db \x85 c d　", "🎉👩‍👩‍👧 é ı İ" + "x" * 300, "1234567890 " * 20, "　 　", "a" * 5000, "ŉ ÿ × ÷ Ŀ ſ ß", "tab\tnew\nline\x0b\x0c",
         "é å ́", "mixed漢字kana カナ 한글", "~!@#$%^&*()_+|}{:?><"]


@pytest.fixture(scope="module")
def piece():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def word():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))


def test_counts_equal_the_library(piece):
    count = token_counts.make_counter(queries.tokenizer_path("piece_bpe_32k.model"))
    docs = pd.read_parquet(f"{SF_SMALL}/documents.parquet").text.tolist()
    for t in TEXTS + docs:
        assert count(t) == len(piece.encode(t)), t[:60]


def test_counting_survives_a_full_cache(piece, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 10)
    count = token_counts.make_counter(queries.tokenizer_path("piece_bpe_32k.model"))
    for t in pd.read_parquet(f"{SF_SMALL}/documents.parquet").text.head(20):
        assert count(t) == len(piece.encode(t))


def test_count_rows(spark, piece):
    df = with_clashes(spark.createDataFrame(EDGE_DOCS, EDGE_SCHEMA))
    got = token_counts.token_counts(df, queries.tokenizer_path("piece_bpe_32k.model")).toPandas()
    assert list(got.columns) == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and len(got) == len(EDGE_DOCS)
    want = sorted((-1 if i is None else i, len((t or "").encode()), len(piece.encode(t or ""))) for i, t in EDGE_DOCS)
    assert sorted(zip(got.doc_id.fillna(-1).astype(int), got.n_bytes, got.n_tokens)) == want
    assert got[got.doc_id == 8].over_limit.all() and not got[got.doc_id == 4].over_limit.any()
    assert token_counts.token_counts(df.limit(0), queries.tokenizer_path("piece_bpe_32k.model")).count() == 0


def _same(encoder, word, text):
    ids = word.encode(text, add_special_tokens=False).ids
    got, shown = encoder.encode(text)
    assert got == np.array(ids, "<u4").tobytes(), text[:80]
    assert shown == word.decode(ids, skip_special_tokens=False), text[:80]


def test_codec_equals_the_library(word):
    encoder = bpe_codec.ChunkEncoder(queries.tokenizer_path("word_bpe_49k.json"))
    for t in TEXTS + pd.read_parquet(f"{SF_SMALL}/documents.parquet").text.tolist():
        _same(encoder, word, t)
    assert encoder.reused > 0


def _held(cache) -> int:
    from sys import getsizeof
    return getsizeof(cache) + sum(getsizeof(k) + getsizeof(v) for k, v in cache.items())


def test_caches_of_a_worker_stay_small(word):
    """Words that never come again: an executor holds these caches once for each core beside its heap."""
    encoder = bpe_codec.ChunkEncoder(queries.tokenizer_path("word_bpe_49k.json"))
    for at in range(0, 240_000, 2000):
        encoder.encode(" ".join(f"{i:06d}" for i in range(at, at + 2000)))
    caches = [c for n, c in vars(encoder).items() if isinstance(c, dict) and n != "chunks"]
    assert sum(map(_held, caches)) < 24 << 20 and encoder.held <= 8 << 20
    for t in TEXTS:
        _same(encoder, word, t)


def test_words_that_come_again_are_merged_once(word):
    """As many as a task of real texts holds; lookups cost a tenth of merging."""
    encoder = bpe_codec.ChunkEncoder(queries.tokenizer_path("word_bpe_49k.json"))
    letters = str.maketrans("0123456789", "etaoinshrl")
    words = [f"{i:05d}".translate(letters) for i in range(60_000)]
    texts = [" ".join(words[at:at + 2000]) for at in range(0, 60_000, 2000)]
    merged = []

    class Model:
        def tokenize(self, piece, model=encoder.model):
            merged.append(piece)
            return model.tokenize(piece)
    encoder.model = Model()
    for t in [*texts, *(" ".join(t.split()[::-1]) for t in texts)]:     # other chunks of the same words
        encoder.encode(t)
    assert len(merged) < 62_000                      # and the few words that a cut of the text falls into
    _same(encoder, word, texts[3])


def test_what_a_full_cache_held_is_found_again(word, monkeypatch):
    monkeypatch.setattr(bpe_codec, "WORD_CACHE", 5)
    encoder = bpe_codec.ChunkEncoder(queries.tokenizer_path("word_bpe_49k.json"))
    for t in TEXTS + ["a b c d", "e f g", "a e", "a b c d e f g h i j", "a " * 40 + "é" * 200] * 2:
        _same(encoder, word, t)
        assert len(encoder.parts) <= 5 and len(encoder.last_parts) <= 5


def test_batches_are_cut_by_bytes():
    import pyarrow as pa
    from ledgerlens.llm import common
    batch = pa.RecordBatch.from_pydict({"n": list(range(300)), "text": ["x" * 9000] * 299 + ["y" * (3 << 20)]})
    pieces = list(common.halved(batch))
    assert pa.Table.from_batches(pieces).to_pydict() == batch.to_pydict()
    assert all(p.nbytes <= common.PIECE_BYTES or p.num_rows == 1 for p in pieces) and len(pieces) < 12
    assert [p.num_rows for p in common.halved(batch.slice(0, 0))] == [0]


def test_joins_are_repaired_at_any_cut(word, monkeypatch):
    text = pd.read_parquet(f"{SF_SMALL}/documents.parquet").text[0][:400] + " l'été<|endoftext|>漢字 don't 12"
    data = text.encode()
    for step in (1, 2, 3, 7, 50):
        def every(d, step=step):
            ends = [e for e in range(step, len(d), step) if d[e] & 0xC0 != 0x80]
            return [*ends, len(d)]
        monkeypatch.setattr(bpe_codec, "cuts", every)
        _same(bpe_codec.ChunkEncoder(queries.tokenizer_path("word_bpe_49k.json")), word, text)
    assert len(data) > 400


def test_cuts_depend_on_content_only():
    shared = pd.read_parquet(f"{SF_SMALL}/documents.parquet").text.str.cat(sep="\n").encode()[:40_000]
    def inner(prefix):
        d = prefix + shared
        return {e - len(prefix) for e in bpe_codec.cuts(d)[:-1] if e - len(prefix) > bpe_codec.WINDOW}
    assert inner(b"") == inner(b"some other beginning ") and len(inner(b"")) > 20


def test_codec_rows(spark, word):
    df = with_clashes(spark.createDataFrame(EDGE_DOCS, EDGE_SCHEMA))
    out = bpe_codec.encode_decode(df, queries.tokenizer_path("word_bpe_49k.json"))
    got = out.toPandas()
    assert list(got.columns) == ["doc_id", "n_tokens", "ids", "decoded"] and len(got) == len(EDGE_DOCS)
    assert (got.n_tokens == got.ids.map(len) // 4).all()
    assert got[got.doc_id == 1].decoded.tolist() == [""]
    assert bpe_codec.encode_decode(df.limit(0), queries.tokenizer_path("word_bpe_49k.json")).count() == 0
