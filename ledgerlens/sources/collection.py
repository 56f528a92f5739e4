"""A named, versioned collection of documents and their chunks (SNK-4, SRC-9).

Below ``root/name`` lie segments, each written once and never changed, and one
manifest for each version that lists the segments it is made of.  Adding or
replacing documents writes one new segment: the documents whose content changed,
their chunks, and the texts and postings of chunks that no earlier segment has
(chunks are keyed by content).  What a version holds of a document is what the
last segment with that document says; a removed document has a row without
chunks.  A version commits by the creation of its manifest, which fails if the
version exists, so of two writers one has to try again.

The number of texts with each bucket is kept for every version and changes by
the texts that came and went, so no version reads the whole collection to be
made or searched.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.partitioning import dealt_by_bytes
from ..operators.text_index import POSTING_BYTES, best_texts, postings_of, ranked_places, stats_of, text_key, weighted_queries, with_rest, write_postings
from ..session import stored

#: ``(docs, id_col, text_col) -> id_col, chunk_no, chunk``
Splitter = Callable[[DataFrame, str, str], DataFrame]


class Collection:
    """One version of a collection.  ``create``, ``open``, ``put``, ``remove`` and ``compact`` return versions; none changes an earlier one."""

    def __init__(self, spark: SparkSession, root: str, name: str, version: int, state: dict):
        self.spark, self.root, self.name, self.version, self.state = spark, root, name, version, state

    # -- files ---------------------------------------------------------------

    @property
    def path(self) -> str:
        return f"{self.root.rstrip('/')}/{self.name}"

    @staticmethod
    def _fs(spark: SparkSession, path: str):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()), p

    @classmethod
    def _commit(cls, spark: SparkSession, root: str, name: str, version: int, state: dict) -> "Collection":
        fs, p = cls._fs(spark, f"{root.rstrip('/')}/{name}/manifests/{version:08d}.json")
        if fs.exists(p):
            raise FileExistsError(f"version {version} of {name} exists: another writer was first")
        # written whole under a name of its own, then given its name, which fails if that is taken meanwhile
        own = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{version:08d}-{spark._jvm.java.util.UUID.randomUUID().toString()}")
        out = fs.create(own, False)
        out.write(bytearray(json.dumps(state, indent=1).encode()))
        out.close()
        if fs.exists(p) or not fs.rename(own, p):
            fs.delete(own, False)
            raise FileExistsError(f"version {version} of {name} exists: another writer was first")
        return cls(spark, root, name, version, state)

    @classmethod
    def create(cls, spark: SparkSession, root: str, name: str, id_type: str = "bigint") -> "Collection":
        return cls._commit(spark, root, name, 0, {"id_type": id_type, "segments": [], "texts": 0, "stats": None})

    @classmethod
    def open(cls, spark: SparkSession, root: str, name: str, version: int | None = None) -> "Collection":
        """The last version, or the given one."""
        fs, folder = cls._fs(spark, f"{root.rstrip('/')}/{name}/manifests")
        found = sorted(int(f.getPath().getName()[:8]) for f in fs.listStatus(folder) if not f.getPath().getName().startswith(".")) if fs.exists(folder) else []
        if not found or (version is not None and version not in found):
            raise FileNotFoundError(f"no collection {name}" + (f" in version {version}" if version is not None else "") + f" below {root}")
        version = found[-1] if version is None else version
        text = spark.read.text(f"{root.rstrip('/')}/{name}/manifests/{version:08d}.json", wholetext=True).first()[0]
        return cls(spark, root, name, version, json.loads(text))

    def _segments(self, table: str, schema: str) -> DataFrame:
        """All segments' rows of a table with their segment's number."""
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/segments/{s}/{table}").withColumn("segment", F.lit(i)) for i, s in enumerate(self.state["segments"])]
        out = self.spark.createDataFrame([], f"{schema}, segment int")
        for p in parts:
            out = out.unionByName(p)
        return out

    # -- reading ---------------------------------------------------------------

    def documents(self) -> DataFrame:
        """``doc_id, content, segment``: what this version holds of each document."""
        rows = self._segments("documents", f"doc_id {self.state['id_type']}, content binary")
        last = rows.groupBy("doc_id").agg(F.max_by(F.struct("content", "segment"), "segment").alias("last"))
        return last.select("doc_id", "last.content", "last.segment").where("content IS NOT NULL")

    def places(self) -> DataFrame:
        """``doc_id, chunk_no, key``."""
        rows = self._segments("places", f"doc_id {self.state['id_type']}, chunk_no bigint, key binary")
        return rows.join(stored(self.documents().select("doc_id", "segment"), "live"), ["doc_id", "segment"], "left_semi").drop("segment")

    def texts(self) -> DataFrame:
        """``key, text`` of all segments, also of chunks that no document has any more."""
        return self._segments("texts", "key binary, text string").drop("segment")

    def chunks(self) -> DataFrame:
        """``doc_id, chunk_no, chunk``."""
        return self.places().join(self.texts().withColumnRenamed("text", "chunk"), "key").select("doc_id", "chunk_no", "chunk")

    def search(self, queries: DataFrame, query_id: str, query_text: str, k: int) -> DataFrame:
        """``query_id, doc_id, chunk_no, text, score, rank``: each query's ``k`` best chunks of this version."""
        ids = ["doc_id", "chunk_no"]
        places = stored(self.places(), "places")
        terms = weighted_queries(queries, query_id, query_text, self._stats(), self.state["texts"])
        postings = self._segments("postings", "bucket int, key binary, weight double").drop("segment")
        best = best_texts(postings, terms, k, live=stored(places.select("key").distinct(), "live-keys"))
        hits = stored(ranked_places(best, places, ids, k), "hits")
        hits = with_rest(hits, queries, query_id, places, ids, k)
        return (hits.join(self.texts(), "key").withColumnRenamed("__query", query_id).select(query_id, *ids, "text", "score", "rank"))

    def _stats(self) -> DataFrame:
        schema = "bucket int, texts bigint, top double"
        return self.spark.read.schema(schema).parquet(f"{self.path}/stats/{self.state['stats']}") if self.state["stats"] else self.spark.createDataFrame([], schema)

    # -- writing ---------------------------------------------------------------

    def put(self, docs: DataFrame, id_col: str, text_col: str, splitter: Splitter) -> "Collection":
        """A version with ``docs`` added, or put in place of the documents with their ids.

        Documents whose content is what the collection has already are left out;
        if none is left, no version is made.  Of rows that repeat an id the one
        with the smallest text is taken; rows with a null id are left out.  A null
        text is the empty text; a document without chunks is a document."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        new = (docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast(self.state["id_type"]).alias("doc_id"), text.alias("text"))
               .groupBy("doc_id").agg(F.min("text").alias("text")).withColumn("content", text_key(F.col("text"))))
        old = stored(self.documents(), "old")
        changed = stored(new.join(old.select("doc_id", "content"), ["doc_id", "content"], "left_anti"), "changed")
        return self._next(changed, old, splitter)

    def remove(self, ids: DataFrame, id_col: str) -> "Collection":
        """A version without the documents with these ids; ids that it doesn't hold are ignored."""
        old = stored(self.documents(), "old")
        gone = old.join(ids.select(F.col(id_col).cast(self.state["id_type"]).alias("doc_id")).distinct(), "doc_id", "left_semi")
        gone = stored(gone.select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("content")), "gone")
        return self._next(gone, old, None)

    def _next(self, changed: DataFrame, old: DataFrame, splitter: Splitter | None) -> "Collection":
        if changed.isEmpty():
            return self
        number = len(self.state["segments"])
        segment = f"{self.version + 1:08d}-{self.spark._jvm.java.util.UUID.randomUUID().toString()[:8]}"
        at = f"{self.path}/segments/{segment}"
        before = stored(self.places(), "before")
        changed.select("doc_id", "content").write.parquet(f"{at}/documents")
        if splitter is not None:
            made = splitter(changed.select("doc_id", "text"), "doc_id", "text").select("doc_id", "chunk_no", F.col("chunk").alias("text")).withColumn("key", text_key(F.col("text")))
            made = stored(made, "made")
        else:
            made = self.spark.createDataFrame([], f"doc_id {self.state['id_type']}, chunk_no bigint, text string, key binary")
        made.select("doc_id", "chunk_no", "key").write.parquet(f"{at}/places")
        # texts are written once, whichever segment has them
        known = self.texts().select("key")
        fresh = made.select("key", "text").groupBy("key").agg(F.first("text").alias("text")).join(known, "key", "left_anti")
        fresh.write.parquet(f"{at}/texts")
        fresh = self.spark.read.schema("key binary, text string").parquet(f"{at}/texts")
        write_postings(postings_of(dealt_by_bytes(fresh, "key", POSTING_BYTES)), f"{at}/postings")
        after = Collection(self.spark, self.root, self.name, self.version, self.state | {"segments": [*self.state["segments"], segment]})
        # texts that came and went, by the places of the changed documents; a text may still be elsewhere
        gone = before.join(changed.select("doc_id"), "doc_id", "left_semi").select("key").distinct()
        left = stored(after.places().select("key").distinct(), "after-keys")
        lost = stored(gone.join(left, "key", "left_anti"), "lost")
        came = stored(made.select("key").distinct().join(before.select("key").distinct(), "key", "left_anti"), "came")
        # all new texts came; of those that came back or went the few postings are made again
        # from the texts, which is less to move than every segment's postings
        back = stored(came.join(fresh.select("key"), "key", "left_anti"), "back")
        ours = self.spark.read.schema("bucket int, key binary, weight double").parquet(f"{at}/postings")
        moved = stats_of(ours).withColumn("sign", F.lit(1))
        for keys, sign in ((back, 1), (lost, -1)):
            if not keys.isEmpty():
                counted = stats_of(postings_of(self.texts().join(keys, "key", "left_semi"))).withColumn("sign", F.lit(sign))
                moved = moved.unionByName(counted if sign > 0 else counted.withColumn("top", F.lit(0.0)))
        # a bucket's largest weight may stay too large when a text goes; as a bound it stays right
        stats = (self._stats().withColumn("sign", F.lit(1)).unionByName(moved).groupBy("bucket").agg(F.sum(F.col("texts") * F.col("sign")).alias("texts"), F.max("top").alias("top"))
                 .where("texts > 0"))
        stats.coalesce(1).write.parquet(f"{self.path}/stats/{segment}")                                  # at most as many rows as buckets
        state = after.state | {"texts": self.state["texts"] + came.count() - lost.count(), "stats": segment}
        return self._commit(self.spark, self.root, self.name, self.version + 1, state)

    def compact(self) -> "Collection":
        """A version in one segment that holds this version's documents and nothing else.  Earlier versions stay readable."""
        segment = f"{self.version + 1:08d}-{self.spark._jvm.java.util.UUID.randomUUID().toString()[:8]}"
        at = f"{self.path}/segments/{segment}"
        places = stored(self.places(), "places")
        self.documents().select("doc_id", "content").write.parquet(f"{at}/documents")
        places.write.parquet(f"{at}/places")
        live = stored(places.select("key").distinct(), "live-keys")
        self.texts().join(live, "key", "left_semi").write.parquet(f"{at}/texts")
        write_postings(self._segments("postings", "bucket int, key binary, weight double").drop("segment").join(live, "key", "left_semi"), f"{at}/postings")
        stats_of(self.spark.read.parquet(f"{at}/postings")).coalesce(1).write.parquet(f"{self.path}/stats/{segment}")
        return self._commit(self.spark, self.root, self.name, self.version + 1, self.state | {"segments": [segment], "texts": live.count(), "stats": segment})
