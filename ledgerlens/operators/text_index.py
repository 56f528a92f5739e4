"""Text search over hashed terms with an inverted index (RET-5..7, RET-9).

The reference embeds with a sentence model whose weights are not available; this
stand-in tells topics apart by their words.  A word is a bucket of its md5, a
text a sparse vector of term counts over the square root of its length, and a
query's score with it the sum over shared buckets of

    count in the query * idf^2 * count in the text / sqrt(words of the text),
    idf = ln((texts + 1) / (texts with the bucket + 1)).

Equal texts are one text (keyed by content) with many places.  Each file of the
posting table is sorted by bucket; of each bucket the number of texts and the largest weight
are kept.  A search takes each query's strongest terms first; the k-th partial
sum is a bound that the weak terms together may not reach: texts that have only
those are never looked at, and what remains of the long lists is read for the
candidates alone.  All steps are joins and grouped sums on Spark.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.partitioning import dealt_by_bytes, ensure_parallelism
from ..session import stored

BUCKETS = 1 << 18
#: Everything in ASCII that is no letter or digit ends a word; all other characters belong to words.
SEPARATED = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
#: Words whose buckets a task keeps, and words that it counts at once (those of one text at least).
KNOWN = 100_000
COUNTED = 100_000
#: Stored bytes of texts whose postings one task sorts (they take some thirty times the memory).
POSTING_BYTES = 8 << 20
#: Scores are ranked by this many digits, so that sums in another order rank alike.
DIGITS = 9


class Buckets(dict):
    """Words (bytes) to their buckets, by the first 32 bits of the md5; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        bucket = int.from_bytes(md5(word, usedforsecurity=False).digest()[:4], "big") % BUCKETS
        if len(self) >= KNOWN:
            self.clear()
        self[word] = bucket
        return bucket


def text_key(text: Column) -> Column:
    """16 bytes of the content's SHA-256."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def term_counts(df: DataFrame, keys: Sequence[str], text_col: str) -> DataFrame:
    """``keys, length, bucket, count``: the words of each row's text by bucket, counted
    within the row by Arrow tasks (each distinct word is hashed once), so nothing is shuffled."""
    given = df.select(*keys, F.lower(F.col(text_col)).alias("__text"))
    schema = T.StructType([*given.schema.fields[:-1], T.StructField("length", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("count", T.LongType())])
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets()

        def counted(batch: pa.RecordBatch, rows: list, lengths: list, words: list) -> pa.RecordBatch:
            at, sizes = np.array(rows, np.int64), np.array(lengths, np.int64)
            x = np.sort(np.repeat(np.arange(len(at)), sizes) * BUCKETS + np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
            start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, np.int64)
            of, bucket = np.divmod(x[start], BUCKETS)
            taken = pa.array(at[of])
            columns = [batch.column(i).take(taken) for i in range(len(keys))] + [pa.array(sizes[of]), pa.array(bucket), pa.array(np.diff(np.r_[start, len(x)]))]
            return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, out.types)], schema=out)

        for batch in batches:
            rows, lengths, words = [], [], []
            for i, text in enumerate(batch.column(len(keys))):
                if found := (text.as_py() or "").encode().translate(SEPARATED).split():
                    rows.append(i)
                    lengths.append(len(found))
                    words += found
                    if len(words) >= COUNTED:
                        yield counted(batch, rows, lengths, words)
                        rows, lengths, words = [], [], []
            yield counted(batch, rows, lengths, words)

    return given.mapInArrow(run, schema)


def postings_of(texts: DataFrame) -> DataFrame:
    """``bucket, key, weight`` of a table ``key, text`` without repeated keys."""
    return term_counts(ensure_parallelism(texts), ["key"], "text").select("bucket", "key", (F.col("count") / F.sqrt("length")).alias("weight"))


def stats_of(postings: DataFrame) -> DataFrame:
    """``bucket, texts, top``: how many texts have the bucket and the largest weight there; at most ``BUCKETS`` rows."""
    return postings.groupBy("bucket").agg(F.count("*").alias("texts"), F.max("weight").alias("top"))


def weighted_queries(queries: DataFrame, query_id: str, query_text: str, stats: DataFrame, n_texts: int) -> DataFrame:
    """``__query, bucket, times, bound, texts``: the query's terms that occur, what a
    text's weight is multiplied by, and the most that the term can add."""
    terms = term_counts(queries.select(F.col(query_id).alias("__query"), F.col(query_text).alias("__text")).dropDuplicates(["__query"]), ["__query"], "__text")
    idf = F.log(F.lit(n_texts + 1.0) / (F.col("texts") + 1.0))
    return (terms.join(F.broadcast(stats), "bucket")                                                     # BUCKETS rows at most
            .select("__query", "bucket", (F.col("count") * idf * idf).alias("times"), "texts", "top")
            .withColumn("bound", F.col("times") * F.col("top")).where("bound > 0").drop("top"))


def best_texts(postings: DataFrame, terms: DataFrame, k: int, live: DataFrame | None = None, counts: dict | None = None) -> DataFrame:
    """``__query, key, score`` of every text that is among a query's first ``k``
    by rounded score, ties included.  ``live`` (keys) leaves other texts out.
    ``counts`` gets the postings of the queries' terms and those that were summed
    without being asked for by a candidate."""
    terms = stored(terms, "terms")
    strongest = Window.partitionBy("__query").orderBy(F.desc("bound"), "bucket")
    # the terms' lists alone, before anything is joined to their texts
    postings = postings.join(F.broadcast(terms.select("bucket").distinct()), "bucket", "left_semi")
    if live is not None:
        postings = stored(postings.join(live, "key", "left_semi"), "live-postings")

    def sums(of: DataFrame) -> DataFrame:
        return postings.join(of, "bucket").groupBy("__query", "key").agg(F.sum(F.col("times") * F.col("weight")).alias("score"))

    before = F.coalesce(F.sum("texts").over(strongest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = terms.withColumn("before", before).where(F.col("before") < k)
    nth = Window.partitionBy("__query").orderBy(F.desc("score"), "key")
    floor = (sums(first.select("__query", "bucket", "times")).withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= k)
             .groupBy("__query").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") == k).drop("n"))
    # weakest terms first: as long as all of them together stay below the floor, a text needs another term
    weakest = Window.partitionBy("__query").orderBy("bound", F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    told = terms.join(floor, "__query", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) * (1 - 1e-9))
    told = stored(told.withColumn("weak", F.sum("bound").over(weakest) < F.col("floor")), "told")
    rest = told.groupBy("__query", "floor").agg(F.sum(F.when(F.col("weak"), F.col("bound")).otherwise(0.0)).alias("rest"))
    strong = sums(told.where(~F.col("weak")).select("__query", "bucket", "times"))
    candidates = stored(strong.join(rest, "__query").where(F.col("score") + F.col("rest") >= F.col("floor")).select("__query", "key"), "candidates")
    if counts is not None:
        counts |= {"postings": told.agg(F.coalesce(F.sum("texts"), F.lit(0))).first()[0],
                   "summed": told.where(~F.col("weak")).agg(F.coalesce(F.sum("texts"), F.lit(0))).first()[0], "candidates": candidates.count()}
    full = (postings.join(told.select("__query", "bucket", "times"), "bucket").join(candidates, ["__query", "key"])
            .groupBy("__query", "key").agg(F.round(F.sum(F.col("times") * F.col("weight")), DIGITS).alias("score")))
    by_score = Window.partitionBy("__query").orderBy(F.desc("score"))
    return full.withColumn("__rank", F.rank().over(by_score)).where(F.col("__rank") <= k).drop("__rank")


def ranked_places(texts: DataFrame, places: DataFrame, ids: Sequence[str], k: int) -> DataFrame:
    """``__query, ids..., key, score, rank``: the first ``k`` places of the best texts (ties by the ids)."""
    w = Window.partitionBy("__query").orderBy(F.desc("score"), *ids)
    return (places.select(*ids, "key").join(stored(texts, "texts"), "key").withColumn("rank", F.row_number().over(w).cast("bigint"))
            .where(F.col("rank") <= k).select("__query", *ids, "key", "score", "rank"))


def with_rest(hits: DataFrame, queries: DataFrame, query_id: str, places: DataFrame, ids: Sequence[str], k: int) -> DataFrame:
    """``hits`` (stored, of ``ranked_places``) and, for queries with fewer than ``k``,
    the first other places by the ids with a score of 0: a search returns ``k`` rows if there are as many."""
    found = hits.groupBy("__query").agg(F.count("*").alias("__n"))
    short = queries.select(F.col(query_id).alias("__query")).distinct().join(found, "__query", "left").where(F.coalesce("__n", F.lit(0)) < k).select("__query")
    if short.isEmpty():
        return hits
    # fewer than k of the first 2k places are hits
    first = stored(places.select(*ids, "key").orderBy(*ids).limit(2 * k), "first-places")
    rest = short.crossJoin(F.broadcast(first)).join(hits.select("__query", *ids), ["__query", *ids], "left_anti")
    rest = rest.select("__query", *ids, "key", F.lit(0.0).alias("score"))
    w = Window.partitionBy("__query").orderBy(F.desc("score"), *ids)
    return stored(hits.drop("rank").unionByName(rest).withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)
                  .select("__query", *ids, "key", "score", "rank"), "hits")


class TextIndex:
    """The index of a table of texts below ``path``: ``postings`` in files sorted by bucket, ``stats``, ``places``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @staticmethod
    def build(docs: DataFrame, ids: Sequence[str], text_col: str, path: str) -> "TextIndex":
        """Indexes every row.  Null texts and texts without a word have a place but
        no postings, so their score is 0; repeated rows are places of their own."""
        index = TextIndex(docs.sparkSession, path)
        docs.select(*ids, F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", text_key(F.col("text"))).write.parquet(f"{path}/places")
        texts = index.table("places").groupBy("key").agg(F.first("text").alias("text"))
        write_postings(postings_of(dealt_by_bytes(texts, "key", POSTING_BYTES)), f"{path}/postings")
        stats_of(index.table("postings")).coalesce(1).write.parquet(f"{path}/stats")
        return index

    def search(self, queries: DataFrame, query_id: str, query_text: str, k: int, counts: dict | None = None) -> DataFrame:
        """``query_id, ids..., text, score, rank``: each query's ``k`` best rows, ties by
        the ids; rows that share no telling word with it have the score 0."""
        ids = [c for c in self.table("places").columns if c not in ("key", "text")]
        n = self.table("places").select("key").distinct().count()
        terms = weighted_queries(queries, query_id, query_text, self.table("stats"), n)
        places = self.table("places")
        hits = stored(ranked_places(best_texts(self.table("postings"), terms, k, counts=counts), places, ids, k), "hits")
        hits = with_rest(hits, queries, query_id, places, ids, k)
        texts = places.select("key", "text").join(hits.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
        return hits.join(texts, "key").withColumnRenamed("__query", query_id).select(query_id, *ids, "text", "score", "rank")


def write_postings(postings: DataFrame, path: str) -> None:
    """Each task's lists by themselves, sorted by bucket, as a segment of the index:
    a search for few terms reads few pages of each, and no list is in one task."""
    postings.sortWithinPartitions("bucket").write.parquet(path)
