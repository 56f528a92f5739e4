"""Language identification on held-out documents; n-grams and centroids against plain Python."""
import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import language_id as L
from ledgerlens.llm import queries

from ..conftest import SF_MID
from .helpers import with_clashes

SAMPLES = {"en": "the cat and the dog were walking through the old town", "de": "der hund und die katze gingen durch die alte stadt",
           "ru": "кошка и собака шли через старый город", "ja": "猫と犬が古い町を歩いていました"}


def plain_grams(text):
    """n-grams of lower-case words with their ends, by plain loops."""
    out, words = Counter(), "".join(c.lower()[0] if c.isalpha() else " " for c in text).split()
    for w in words:
        out.update(w)
        out.update(a + b for a, b in zip(f" {w}", f"{w} "))
        out.update(f" {w} "[i:i + 3] for i in range(len(w)))
    return out


def test_grams_are_the_plain_ones():
    for text in [*SAMPLES.values(), "Ünïcode-Straße 12 don't  x", "a", " \n b\t", "İstanbul 5km"]:
        want, by = plain_grams(text), Counter()
        for g, n in want.items():
            x = np.array([ord(c) for c in g], np.uint32)
            # alone, a letter's only n-gram inside spaces is itself; of two or three characters the longest comes last
            by[int(L._grams(np.array([32, x[0], 32], np.uint32))[0] if len(g) == 1 else L._grams(x)[-1])] += n
        at, counts = L.profile(text)
        assert dict(zip(at.tolist(), counts.tolist())) == dict(by)


def test_pieces_equal_the_whole(monkeypatch):
    texts = pd.read_parquet(f"{SF_MID}/documents.parquet").text.head(20).tolist() + ["x" * 50 + " y" * 40, "   " * 30 + "a", "1 2 3 " * 20 + "b c" + " " * 60]
    whole = [L.profile(t) for t in texts]
    monkeypatch.setattr(L, "PIECE_CHARS", 37)
    for t, w in zip(texts, whole):
        p = L.profile(t)
        if max(map(len, t.split())) < 30:                            # a word longer than a piece is cut
            assert (p[0] == w[0]).all() and (p[1] == w[1]).all(), t[:40]
    assert L.profile("12 34 " * 30) is None and L.profile(None) is None and L.profile("") is None


def test_clusters_and_prediction_by_plain_loops():
    rng = np.random.default_rng(0)
    axes = np.eye(12)[:3]
    x = np.concatenate([a + rng.normal(size=(30, 12)) * .05 for a in axes])
    x /= np.linalg.norm(x, axis=1)[:, None]
    centers = L.cluster(x, 3)
    assert sorted(np.argmax(centers, axis=1)) == [0, 1, 2] and np.allclose(np.linalg.norm(centers, axis=1), 1)
    assert len(L.cluster(np.repeat(x[:1], 9, 0), 4)) == 1
    idf = np.linspace(1, 2, L.BUCKETS)
    rows = []
    for lang, text in SAMPLES.items():
        c = np.zeros(L.BUCKETS)
        at, n = L.profile(text)
        c[at] = L.weights(at, n, idf)
        rows.append({"lang": lang, "centroid": c.astype("<f4").tobytes(), "reach": .9})
    model = L.Model(idf, rows)
    for text in ["the old dog", "die katze", "город", "町を歩いて"]:
        at, n = L.profile(text)
        w = {int(b): (1 + math.log(k)) * idf[b] for b, k in zip(at, n)}
        size = math.sqrt(sum(v * v for v in w.values()))
        cos = {r["lang"]: sum(v * float(np.frombuffer(r["centroid"], "<f4")[b]) for b, v in w.items()) / size for r in rows}
        lang, score, rejected = model.predict(text)
        assert lang == max(cos, key=cos.get) and score == pytest.approx(cos[lang], abs=1e-9) and rejected == (1 - cos[lang] > .9)
    assert model.predict("ωψχ") == ("en", 0.0, True) and model.predict("12") == ("und", 0.0, True)


def test_held_out_accuracy(spark):
    src = pd.read_parquet(f"{SF_MID}/documents.parquet")
    got = queries.QUERIES["op11_language_id"](spark, SF_MID).toPandas().merge(src, on="doc_id")
    assert len(got) == len(src) and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all() and got.held_out.any()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() >= 0.99
    assert held.rejected.mean() < 0.05


def test_nothing_is_learned_from_held_out_rows(spark):
    """Other texts and languages of held-out rows change no prediction."""
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").where("doc_id < 300")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    wrong = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    a, b = (L.identify(d).orderBy("doc_id").toPandas() for d in (docs, wrong))
    assert a.equals(b)


def test_edge_rows(spark):
    taught = [i for i in range(1, 400) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, SAMPLES[k] + " " + k * (j % 3), k) for j, i in enumerate(taught[:80]) for k in [list(SAMPLES)[j % 4]]]
    odd = [(500, None, "en"), (501, "", "en"), (502, "12 34 !!", "de"), (503, "the dog", None), (None, "die katze", "de"), (504, "x" * 300_000, "en"),
           (505, "the dog", "en"), (505, "the dog", "en"), (506, "ωψχ", None)]
    df = with_clashes(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")).withColumn("rejected", F.lit("clash"))
    got = L.identify(df).toPandas()
    assert list(got.columns) == ["doc_id", "held_out", "lang_pred", "score", "rejected"] and len(got) == len(rows) + len(odd)
    by = got.drop_duplicates().set_index("doc_id")
    assert (by.loc[[500, 501, 502]].lang_pred == "und").all() and (by.loc[[500, 501, 502]].score == 0).all()
    assert by.loc[503].lang_pred == "en" and by.loc[[r[0] for r in rows]].lang_pred.tolist() == [r[2] for r in rows]
    assert by.loc[506].rejected and not by.loc[rows[0][0]].rejected
    null = got[got.doc_id.isna()]
    assert null.lang_pred.tolist() == ["de"] and not null.held_out.any()
    assert L.identify(df.limit(0)).count() == 0
    none = L.identify(df.withColumn("lang", F.lit(None).cast("string"))).toPandas()
    assert (none.lang_pred == "und").all() and len(none) == len(got)
