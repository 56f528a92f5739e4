"""The recursive splitter against the documented rule, written out with strings."""
import pandas as pd
import pytest

from ledgerlens.operators.retrieval import chunk_recursive, split_recursive

from .conftest import SF_MID

SEPARATORS = ["\n\n", "\n", " ", ""]


def merge(pieces, size, overlap):
    out, queue = [], []
    for p in pieces:
        if queue and sum(map(len, queue)) + len(p) > size:
            out.append("".join(queue))
            while queue and (sum(map(len, queue)) > overlap or sum(map(len, queue)) + len(p) > size):
                queue = queue[1:]
        queue = queue + [p]
    return out + (["".join(queue)] if queue else [])


def rule(text, size, overlap, separators):
    used = next((s for s in separators if s == "" or s in text), separators[-1])
    rest = separators[separators.index(used) + 1:]
    pieces = list(text) if used == "" else [text.split(used)[0], *(used + x for x in text.split(used)[1:])]
    out, short = [], []
    for p in filter(None, pieces):
        if len(p) < size:
            short.append(p)
            continue
        out += merge(short, size, overlap)
        short = []
        out += rule(p, size, overlap, rest) if rest else [p]
    return out + merge(short, size, overlap)


def plain(text, size, overlap, separators=SEPARATORS):
    return [x.strip() for x in rule(text, size, overlap, separators) if x.strip()] if text else []


EDGES = ["", " ", "\n\n\n\n", "a", "x" * 2500, "\n\n".join(["a b c"] * 300), "\n" * 7 + "one\n\n\ntwo \n three" * 40, "word " * 400 + "y" * 1300 + " tail\n\n" + "z " * 30,
         "漢字" * 900 + " \n" + "é è " * 200, "  lead" + " " * 1200 + "end  ", "\n\n" + "p " * 700 + "\n\n" + "q" * 999 + "\n\n" + "r" * 1000 + "\n\n" + "s" * 1001, "　a　" * 600]


@pytest.mark.parametrize("size, overlap", [(1000, 200), (50, 10), (7, 3), (2, 1), (1, 0), (20, 0)])
def test_edge_texts(size, overlap):
    for t in EDGES:
        assert split_recursive(t, size, overlap) == plain(t, size, overlap), t[:30]
    assert split_recursive(None) == []
    for seps in ([" "], ["\n", " "], ["|", ""]):
        for t in EDGES[:8]:
            assert split_recursive(t, size, overlap, seps) == plain(t, size, overlap, seps)


def test_all_documents(spark):
    docs = pd.read_parquet(f"{SF_MID}/documents.parquet")
    got = chunk_recursive(spark.read.parquet(f"{SF_MID}/documents.parquet"), "doc_id", "text").toPandas().sort_values(["doc_id", "chunk_no"])
    want = [(i, n, c) for i, t in sorted(zip(docs.doc_id, docs.text)) for n, c in enumerate(plain(t, 1000, 200))]
    assert list(got.itertuples(index=False, name=None)) == want
