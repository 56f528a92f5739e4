"""Steps of retrieval whose cost was cut: counted in the row, written once, passed on at once."""

import re
from collections import Counter

from pyspark.sql import functions as F

from ledgerlens.operators import retrieval as RT
from ledgerlens.operators import text_index as TI
from ledgerlens.plans.flows import full_run
from ledgerlens.sources import collection as CO
from ledgerlens.sources.collection import Collection


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_without_a_shuffle(spark):
    texts = spark.createDataFrame([(1, "a b a, c! A"), (2, ""), (3, None), (4, "..."), (5, "x")], "key int, text string")
    counted = TI.term_counts(texts, ["key"], "text")
    assert "Exchange" not in _plan(counted)
    rows = counted.collect()
    assert sorted((r["key"], r["length"], r["count"]) for r in rows) == [(1, 5, 1), (1, 5, 1), (1, 5, 3), (5, 1, 1)]
    md5 = F.conv(F.substring(F.md5(F.lit("a")), 1, 8), 16, 10).cast("bigint") % TI.BUCKETS
    assert {r["bucket"] for r in rows if r["count"] == 3} == {spark.range(1).select(md5).first()[0]}


def test_postings_are_sorted_where_they_are(spark, tmp_path):
    texts = spark.range(1000).select(F.col("id").cast("string").cast("binary").alias("key"), F.concat_ws(" ", F.lit("word"), "id").alias("text"))
    seen = []
    df = TI.postings_of(texts.repartition(4))
    write, kind = type(df).repartitionByRange, type(df)
    kind.repartitionByRange = lambda self, *a: seen.append(a) or write(self, *a)
    try:
        TI.write_postings(df, str(tmp_path / "postings"))
    finally:
        kind.repartitionByRange = write
    assert not seen
    assert spark.read.parquet(str(tmp_path / "postings")).count() == 2000


def test_collection_counts_its_texts_without_all_postings(spark, tmp_path, monkeypatch):
    names, keep = [], CO.stored
    monkeypatch.setattr(CO, "stored", lambda df, name: names.append(name) or keep(df, name))
    docs = [(1, "red fox"), (2, "red hen"), (3, "red fox"), (4, "blue owl")]
    c = Collection.create(spark, str(tmp_path), "c")
    c = c.put(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", RT.chunk_fixed)
    c = c.remove(spark.createDataFrame([(2,), (3,), (4,)], "doc_id bigint"), "doc_id")
    # two texts come back, one is new
    c = c.put(spark.createDataFrame([(2, "red hen"), (5, "blue owl"), (6, "red elk")], "doc_id bigint, text string"), "doc_id", "text", RT.chunk_fixed)
    live = c.chunks().select(F.col("chunk").alias("text")).distinct().withColumn("key", TI.text_key(F.col("text")))
    true = {(r["bucket"], r["texts"]) for r in TI.stats_of(TI.postings_of(live)).collect()}
    assert {(r["bucket"], r["texts"]) for r in c._stats().collect()} == true
    assert c.state["texts"] == live.count() == 4
    assert "new" not in names and "back" in names


def test_chunks_are_passed_on_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(RT, "CHUNKS_SENT", 2)
    texts = [(1, "word " * 3000), (2, None), (3, ""), (None, "a b"), (4, "x" * 2500), (5, "line\n\n" * 700)]
    found = RT.chunk_recursive(spark.createDataFrame(texts, "doc_id bigint, text string"), "doc_id", "text").collect()
    want = [(i, n, p) for i, t in texts for n, p in enumerate(RT.split_recursive(t))]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_distinct_words_are_hashed_once(spark, monkeypatch):
    hashed, md5 = [], TI.md5
    monkeypatch.setattr(TI, "md5", lambda w, **how: hashed.append(w) or md5(w, **how))
    monkeypatch.setattr(TI, "KNOWN", 3)
    known, words = TI.Buckets(), ["a", "b", "a", "c", "b", "İx", "a"]
    got = [known[w.encode()] for w in words]
    assert hashed == [w.encode() for w in ("a", "b", "c", "İx", "a")] and len(known) <= 3
    want = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").select(
        F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("bigint") % TI.BUCKETS)
    assert got == [r[0] for r in want.collect()]


def test_terms_of_many_texts_and_keys(spark, monkeypatch):
    monkeypatch.setattr(TI, "COUNTED", 5)
    texts = [(i, None if i % 7 == 3 else f"k{i % 4}", None if i % 5 == 4 else "One two.TWO three-İ " * (i % 6) + "x\x1fy\x7fz") for i in range(60)]
    got = TI.term_counts(spark.createDataFrame(texts, "a bigint, b string, t string"), ["a", "b"], "t").collect()
    want = []
    for a, b, t in texts:
        found = re.findall(r"[^\x00-\x2F:-@\[-`{-\x7F]+", (t or "").lower())
        for n in Counter(TI.Buckets()[w.encode()] for w in found).items():
            want.append((a, b, len(found), *n))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_a_full_run_scores_its_rows_once(spark):
    """What reads the predictions reads them from the shared folder, not from the forest."""
    rows = [(i, i % 9, float(i % 50) + (100.0 if i % 5 == 0 else 0.0), "abc"[i % 3], int(i % 5 == 0)) for i in range(300)]
    r = full_run(spark.createDataFrame(rows, "transaction_id bigint, customer_id bigint, amount double, category string, is_fraud int"))
    files = r.predictions.inputFiles()
    assert files and all("/predictions-" in f for f in files)
    assert r.predictions.count() == 300 and r.summary.count() == 1
