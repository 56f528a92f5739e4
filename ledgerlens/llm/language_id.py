"""Language identification by nearest centroid.

A text is a vector of its letter n-grams, hashed into buckets, weighted by
1 + log(count) and by the buckets' inverse document frequency, of length 1.
Each language has several centroids, clustered from a bounded sample of its
texts.  A text gets the language of the centroid with the largest cosine; one
that is farther from it than the sample's texts reach is marked as rejected.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import bound_batches, release, slices, store

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
#: The centroids are clustered from at most so many different texts of each language.
SAMPLE_TEXTS = 400
CLUSTERS = 4
ROUNDS = 12
#: A text is rejected if it is farther from its centroid than this share of the sample's texts are, and a margin.
REACH, MARGIN = 0.99, 1.15
#: Longer texts are counted piece by piece.
PIECE_CHARS = 1 << 20
#: More values than this are no languages; the centroids of so many take 16384 * 4 * 4 bytes each.
MAX_LANGUAGES = 500
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower-case letter (or mark; else a space), and whether it is a letter."""
    to, letter = np.full(0x110000, 32, np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            letter[c], to[c] = True, ord(s.lower()[0])
        elif unicodedata.category(s) in ("Mn", "Mc"):
            to[c] = c
    return to, letter


def _grams(x: np.ndarray) -> np.ndarray:
    """Buckets of the n-grams of a sequence of letters and single spaces; an n-gram has no space inside."""
    word, out, code = x != 32, [], np.zeros(len(x), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        code = code[:len(x) - n + 1] * np.uint32(0x01000193) + x[n - 1:]
        if n in ORDERS:
            inside = word if n == 1 else np.ones(len(code), bool)
            for k in range(1, n - 1):
                inside = inside & word[k:len(x) - n + 1 + k]
            mixed = (code ^ np.uint32(n * 0x3C6EF372)) * np.uint32(0x9E3779B1)
            out.append(((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(32 - BUCKETS.bit_length() + 1))[inside])
    return np.concatenate(out)


def profile(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """``(buckets, counts)`` of the whole text; None if it has no letter."""
    if not text:
        return None
    to, letter = _letters()
    total, any_letter, last = np.zeros(BUCKETS, np.int64), False, np.full(1, 32, np.uint32)
    for at in range(0, len(text), PIECE_CHARS):
        raw = np.frombuffer(text[at:at + PIECE_CHARS].encode("utf-32-le", "surrogatepass"), np.uint32)
        any_letter = any_letter or bool(letter[raw].any())
        x = np.concatenate([last, to[raw], np.full(1 if at + PIECE_CHARS >= len(text) else 0, 32, np.uint32)])
        keep = np.ones(len(x), bool)
        keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
        x = x[keep]
        # a piece but the last ends with its last space, so that n-grams and their ends are whole; a word without end goes as it is
        end = len(x) - int(np.argmax(x[::-1] == 32)) if (x[1:] == 32).any() else len(x)
        if len(x[:end]) > 1:
            total += np.bincount(_grams(x[:end]), minlength=BUCKETS)
        last = x[max(0, end - 1):]
    if not any_letter:
        return None
    at = np.flatnonzero(total)
    return at, total[at]


def weights(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(counts)) * idf[at]
    return w / max(float(np.sqrt(w @ w)), 1e-300)


def cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means of rows of length 1, from the rows that are farthest apart; centroids of length 1."""
    first = int(np.argmax(x @ x.mean(axis=0)))
    centers = x[[first]]
    while len(centers) < min(k, len(x)):
        near = (x @ centers.T).max(axis=1)
        if near.min() > 1 - 1e-9:
            break
        centers = np.concatenate([centers, x[[int(np.argmin(near))]]])
    for _ in range(ROUNDS):
        own = np.argmax(x @ centers.T, axis=1)
        sums = np.stack([x[own == c].sum(axis=0) for c in range(len(centers))])
        length = np.linalg.norm(sums, axis=1)
        moved = np.where(length[:, None] > 0, sums / np.maximum(length, 1e-300)[:, None], centers)
        if np.allclose(moved, centers):
            break
        centers = moved
    return centers


def remainder(id_col: str) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts of the one-column table have each bucket, and how many have a letter; over all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS + 1, np.int64)                       # the last place counts the texts
        for batch in slices(batches):
            for text in batch.column(0):
                if (p := profile(text.as_py())) is not None:
                    df[p[0]] += 1
                    df[-1] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["bucket", "n"])

    bound_batches(texts.sparkSession)
    found = texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()       # BUCKETS + 1 rows at most
    df = np.zeros(BUCKETS + 1, np.int64)
    for r in found:
        df[r["bucket"]] = r["n"]
    return df[:-1], int(df[-1])


def _sample(learn: DataFrame, size: int) -> DataFrame:
    """At most ``size`` different texts of each language, those with the smallest hashes."""
    place = F.xxhash64("text") / F.lit(2.0 ** 64) + 0.5             # 0 to 1
    known = store(learn.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")), "languages")
    if known.count() > MAX_LANGUAGES:
        raise ValueError(f"the language column has over {MAX_LANGUAGES} values")
    few = (learn.join(known, "lang").withColumn("place", place).where(F.col("place") * F.col("n") < 2.0 * size)
           .select("lang", "place", "text").distinct())
    from pyspark.sql import Window
    return few.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))).where(F.col("nth") <= size).select("lang", "text")


def centroids(learn: DataFrame, idf: np.ndarray, size: int = SAMPLE_TEXTS, clusters: int = CLUSTERS) -> list[dict]:
    """``lang, centroid, reach`` from the sample; a few rows for each language."""
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(lang, *p) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (p := profile(text)) is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1].astype("<i4").tobytes() for r in rows], pa.binary()),
                 pa.array([weights(r[1], r[2], idf).astype("<f4").tobytes() for r in rows], pa.binary())], names=["lang", "at", "w"])
        release()

    def clustered(key: tuple, t: pa.Table) -> pa.Table:
        x = np.zeros((t.num_rows, BUCKETS))
        for i, (at, w) in enumerate(sorted(zip(t["at"].to_pylist(), t["w"].to_pylist()))):
            x[i, np.frombuffer(at, "<i4")] = np.frombuffer(w, "<f4")
        centers = cluster(x / np.linalg.norm(x, axis=1)[:, None], clusters)
        cos = x @ centers.T
        reach = float(np.quantile(1 - cos.max(axis=1), REACH)) * MARGIN
        return pa.table({"lang": pa.array([key[0].as_py()] * len(centers), pa.string()), "centroid": [c.astype("<f4").tobytes() for c in centers], "reach": [reach] * len(centers)})

    rows = (_sample(learn, size).mapInArrow(vectors, "lang string, at binary, w binary").groupBy("lang").applyInArrow(clustered, "lang string, centroid binary, reach double"))
    return sorted((r.asDict() for r in rows.collect()), key=lambda r: (r["lang"], r["centroid"]))


class Model:
    def __init__(self, idf: np.ndarray, rows: list[dict]):
        self.idf, self.langs = idf, [r["lang"] for r in rows]
        self.reach = np.array([r["reach"] for r in rows])
        self.columns = np.stack([np.frombuffer(r["centroid"], "<f4") for r in rows], axis=1).astype(np.float64) if rows else None

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """``(language, cosine, rejected)``."""
        p = profile(text) if self.langs else None
        if p is None:
            return UNKNOWN, 0.0, True
        cos = weights(*p, self.idf) @ self.columns[p[0]]
        best = int(np.argmax(cos))
        return self.langs[best], min(1.0, max(0.0, float(cos[best]))), bool(1 - cos[best] > self.reach[best])


def fit(learn: DataFrame, size: int = SAMPLE_TEXTS, clusters: int = CLUSTERS) -> Model:
    """From a table ``lang, text``; document frequencies over all of it."""
    df, n = document_frequencies(learn.select("text"))
    idf = np.log((n + 1) / (df + 1)) + 1
    return Model(idf, centroids(learn, idf, size, clusters))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             size: int = SAMPLE_TEXTS, clusters: int = CLUSTERS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` for every row of ``docs``.

    Rows whose ``crc32(id as text) mod 4`` is 2 are held out: nothing is learned
    from them.  The others teach with their text and language if it is not null.
    Document frequencies cover all of those, the centroids at most ``size``
    different texts of each language.  ``lang_pred`` is a learned language, the
    nearest; ``score`` the cosine, 0 to 1; ``rejected`` says that the text is
    farther from the centroid than its language's texts are, so that a user may
    take it for none of them.  Null texts and texts without a letter are ``und``
    with score 0, rejected; so are all if nothing could be learned.  Ties go to
    the language first in order.  A null id is neither held out nor learned from;
    repeated rows give repeated results; an empty table gives no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("doc_id"), remainder(id_col).alias("r"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = fit(src.where("r <> 2 and lang is not null and text is not null").select("lang", "text"), size, clusters)
    held = spark.sparkContext.broadcast(model)                     # 64 kB a centroid
    id_type = src.schema["doc_id"].dataType
    schema = f"doc_id {id_type.simpleString()}, held_out boolean, lang_pred string, score double, rejected boolean"
    from pyspark.sql.pandas.types import to_arrow_schema
    out = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = held.value.predict
        for batch in slices(batches):
            found = [predict(t.as_py()) for t in batch.column(2)]
            cols = list(zip(*found)) if found else [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, f.type) for c, f in zip(cols, list(out)[2:]))], schema=out)

    bound_batches(spark)
    return src.select("doc_id", F.coalesce(F.col("r") == 2, F.lit(False)).alias("held_out"), "text").mapInArrow(run, schema)
