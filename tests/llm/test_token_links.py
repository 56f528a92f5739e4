"""Aligned tokens and their counts against the two libraries; the perfect hash."""
import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import perfect_hash, queries, token_links

from ..conftest import SF_SMALL
from .helpers import EDGE_DOCS, EDGE_SCHEMA, with_clashes

A, B = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
COLS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
ODD = ["", " ", "a  b", " x  ", "\n\n a", "▁a é", "a\u0000b", "<s> </s> <unk> <0x0A>", "x<|endoftext|>y", "I'm don't WE'LL, it's.", "\x1c a\x1db \x85 c d　",
       "a\t \n b", "tail \n ", "tail\t", "\tx", "🎉👩‍👩‍👧 é ı İ" + "x" * 300, "1234567890 " * 20, "　 　", "a" * 3000, "word,word . x ,y; z", "mixed漢字kana カナ 한글", "~!@#$%^&*()_+|}{:?><",
       "a;\r\n b.\r\n\r\nc \r d\r", "étre,  deux;trois­quatre​ cinq", "Ends. \n\nBegins　here .", "(a) [b] {c}. 'quoted' \"twice\"!", "x ▁ y", "the of and " * 50]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(libraries, texts):
    """Every text encoded whole, links and counts by plain loops."""
    a, b = libraries
    visible = {chr(x): x for x in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    visible |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in visible.values())}
    done = []
    for t in texts:
        ids = [], []
        if t:
            ids = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        spelled = ([bytes(visible[c] for c in a.id_to_token(i)) for i in ids[0]],
                   [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) and b.is_byte(i) else p.replace("▁", " ").encode() for i in ids[1] for p in [b.id_to_piece(i)]])
        if not t or any(b"".join(s) != (" " + t).encode() for s in spelled):
            done.append(([], [], []))
            continue
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in spelled]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        last = [dict(zip(e, n)) for e, n in zip(ends, ids)]
        links = [(last[0][e], last[1][e]) for e in cuts]
        side = []
        for e, n in zip(ends, ids):
            side.append([[]])
            for x, i in zip(e, n):
                side[-1][-1].append(str(i))
                if x in last[0] and x in last[1]:
                    side[-1].append([])
        groups = [",".join(x) + "|" + ",".join(y) for x, y in zip(*side)][:-1]
        done.append((ids, links, groups))
    counts = Counter(p for _, links, _ in done for p in links)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(n, best.get(y, 0))
    return [(len(ids[0]) if ids else 0, len(ids[1]) if ids else 0, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links),
             sum(counts[p] for p in links), ";".join(groups)) for ids, links, groups in done]


def result(df):
    return [tuple(r[c] for c in COLS) for r in df.orderBy("doc_id").collect()]


@pytest.mark.parametrize("held", [token_links.HELD_PAIRS, 300, 0])
def test_equals_the_libraries(spark, libraries, held):
    texts = ODD + [None] + [t[:1500] for t in pd.read_parquet(f"{SF_SMALL}/documents.parquet").text.head(60)] + ODD[:12]
    df = with_clashes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).repartition(5)
    got = result(token_links.align(df, A, B, held_pairs=held))
    for t, x, y in zip(texts, got, brute(libraries, texts)):
        assert x == y, repr(t)[:80]


def test_small_tables_pieces_and_shards(spark, libraries, monkeypatch):
    """A table that is cleared all the time, texts cut into pieces, a tree of vectors."""
    texts = pd.read_parquet(f"{SF_SMALL}/documents.parquet").text.str.slice(0, 2000).head(40).tolist() + ["x " * 500 + "▁", "a b " * 400]
    want = brute(libraries, texts)
    monkeypatch.setattr(token_links, "UNITS", 50)
    monkeypatch.setattr(token_links, "PIECE_CHARS", 300)
    token_links.table_of.cache_clear()
    units, done = token_links.Units(token_links.Pair(A, B)), []
    assert units.pair.cuts
    got = {}
    for at, codes in token_links.aligned(units, texts + [None, ""], lambda: done.append(1)):
        got[at] = ";".join([*([got[at]] if at in got else []), *(units.text[c] for c in codes)])
    assert [got.get(i, "") for i in range(len(texts) + 2)] == [w[-1] for w in want] + ["", ""]
    assert len(done) > 10
    pairs = spark.createDataFrame([(k << 32 | j % 97, k % 5 + 1) for j, k in enumerate([*range(3000)] * 3)], "key long, n long").repartition(6)
    got = token_links.as_rows(token_links.count_vectors(pairs, shard_pairs=200, vector_rows=40)).toPandas()
    want = pairs.groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    assert dict(zip(got.key, got.n)) == dict(zip(want.key, want.n)) and len(got) == len(want)
    most = want.groupby(want.key & 0xFFFFFFFF).n.max()
    assert (got.best == (got.n == most[got.key & 0xFFFFFFFF].values)).all()


def test_edge_rows(spark, libraries):
    df = with_clashes(spark.createDataFrame(EDGE_DOCS, EDGE_SCHEMA))
    out = token_links.align(df, A, B)
    assert out.columns == ["doc_id", *COLS] and out.count() == len(EDGE_DOCS)
    want = sorted((-1 if i is None else i, *r) for (i, _), r in zip(EDGE_DOCS, brute(libraries, [t if i != 8 else None for i, t in EDGE_DOCS])) if i != 8)
    long = "x " * 60_000
    got = out.where("doc_id = 8").first()
    a, b = libraries
    assert (got["n_a"], got["n_b"]) == (len(a.encode(" " + long).ids), len(b.encode(long)))
    rest = sorted((-1 if r["doc_id"] is None else r["doc_id"], *(r[c] for c in COLS)) for r in out.where("doc_id is null or doc_id <> 8").collect())
    pos = [1, 2, 3, 4, 7]
    assert [tuple(r[i] for i in pos) for r in rest] == [tuple(r[i] for i in pos) for r in want]
    assert token_links.align(df.limit(0), A, B).count() == 0


def test_query_over_all_documents(spark, libraries):
    docs = pd.read_parquet(f"{SF_SMALL}/documents.parquet").sort_values("doc_id")
    got = queries.QUERIES["op13_token_links"](spark, SF_SMALL).orderBy("doc_id").toPandas()
    want = brute(libraries, docs.text.tolist())
    assert [tuple(r) for r in got[COLS[:-1]].itertuples(index=False)] == [w[:-1] for w in want]
    assert got.groups_sha256.tolist() == [hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "" for w in want]


def test_perfect_hash():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 45, 30_000))
    shard = keys % 5
    t = perfect_hash.Table.of([perfect_hash.build(keys[shard == i]) for i in range(5)])
    slots = t.slots(keys, shard)
    assert sorted(slots.tolist()) == list(range(len(keys))) and (t.keys[slots] == keys).all()
    other = np.setdiff1d(rng.integers(0, 1 << 45, 5000), keys)
    assert (t.slots(other, other % 5) == -1).all()
    none = perfect_hash.build(np.empty(0, np.int64))
    assert (perfect_hash.Table.of([none]).slots(keys[:3], np.zeros(3, np.int64)) == -1).all()
    with pytest.raises(ValueError):
        perfect_hash.build(np.array([5, 5]))
