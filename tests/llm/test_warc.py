"""Archives written and read back."""
import gzip
import hashlib
import json

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import warc_shards as W
from ledgerlens.session import scratch_path

BIG = "<p>" + "é" * 100 + "</p>"
PAGES = [(5, "http://a/5", BIG), (3, "http://a/3 x\r\ny", BIG), (9, None, BIG), (1, "u", "small"), (2, "u", "small"), (4, "u", None), (6, "u", ""),
         (7, "u", "x" * 99), (8, "u", "x" * 99), (10, "u", "y" * 100), (11, "u", "y" * 100), (11, "u", "y" * 100), (None, "u", BIG), (-7, "u", "z" * 300)]
SCHEMA = "page_id long, url string, html string"


def _files(out):
    fs, root = W._fs(out)
    return {f.base_name: fs.open_input_stream(f.path, compression=None).read() for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.endswith(".warc.gz")}


def test_round_trip(spark):
    df = spark.createDataFrame(PAGES, SCHEMA).withColumn("digest", F.lit("clash")).repartition(3)
    out = scratch_path(spark, "warc")
    manifest = W.write(df, out, shard_bytes=1500, roll_bytes=400).collect()
    got = W.read(spark, out).collect()
    firsts = {}
    for p, _, h in PAGES:
        if p is not None and len((h or "").encode()) >= 100:
            firsts[h] = min(p, firsts.get(h, p))
    want = []
    for p, _, h in PAGES:
        data = (h or "").encode()
        to = firsts.get(h) if p is not None and h in firsts and firsts[h] != p else None
        want.append((p, len(data), hashlib.sha256(data).hexdigest(), "response" if to is None else "revisit", to))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        if r["record_type"] == "response":
            assert hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"]
    files = _files(out)
    assert len(files) > 2 and sorted(files) == sorted(m["name"] for m in manifest)
    for m in manifest:
        assert hashlib.sha256(files[m["name"]]).hexdigest() == m["sha256"] and len(files[m["name"]]) == m["bytes"]
    fs, root = W._fs(out)
    assert fs.get_file_info(f"{root}/_parts").type == pafs.FileType.NotFound
    ids = [r["page_id"] for name in sorted(files) for raw in W.members(files[name]) for r in [{"page_id": W.parse(raw)[0].get("X-Page-Id")}]]
    known = [int(i) for i in ids if i is not None]
    assert known == sorted(known)                                   # range-sorted over the files
    assert gzip.decompress(files[sorted(files)[0]]).startswith(b"WARC/1.1\r\n")


def test_same_rows_give_the_same_files(spark):
    a, b = scratch_path(spark, "warc"), scratch_path(spark, "warc")
    df = spark.createDataFrame(PAGES, SCHEMA)
    W.write(df.repartition(5), a, shard_bytes=1500, roll_bytes=400)
    W.write(df.repartition(2).orderBy("url"), b, shard_bytes=1500, roll_bytes=400)
    assert _files(a) == _files(b)


def test_damage_is_found():
    raw = W.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert W.parse(raw)[1] == b"payload"
    with pytest.raises(ValueError):
        W.parse(raw.replace(b"payload", b"pAyload"))
    with pytest.raises(ValueError):
        list(W.members(gzip.compress(raw)[:-9]))


def test_empty_table(spark):
    out = scratch_path(spark, "warc")
    assert W.write(spark.createDataFrame([], SCHEMA), out).count() == 0
    assert W.read(spark, out).count() == 0


def test_one_far_id_and_a_hot_id(spark):
    """Shards are near equal wherever the ids lie; an id of very many rows is dealt over shards."""
    rows = spark.range(20_000).select(F.when(F.col("id") == 0, F.lit(1 << 62)).otherwise(F.col("id") * 3 - 500).alias("page_id"), F.lit("u").alias("url"),
                                      F.concat(F.col("id").cast("string"), F.repeat(F.md5(F.col("id").cast("string")), 3)).alias("html"))
    hot = spark.range(6000).select(F.lit(77).cast("long").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("hot"), F.md5(F.col("id").cast("string"))).alias("html"))
    nulls = hot.withColumn("page_id", F.lit(None).cast("long"))
    for df, most in ((rows, 900), (rows.union(hot).union(nulls), 1200)):
        out = scratch_path(spark, "warc")
        per = W.write(df, out, shard_bytes=500_000).groupBy("shard").agg(F.sum("records").alias("n")).collect()
        assert len(per) > 20 and max(r["n"] for r in per) < most
        assert W.read(spark, out).count() == df.count()


def test_the_reader_goes_by_the_manifest(spark):
    def written():
        out = scratch_path(spark, "warc")
        W.write(spark.createDataFrame(PAGES, SCHEMA), out, shard_bytes=1500, roll_bytes=400)
        return out, *W._fs(out)

    out, fs, root = written()
    names = sorted(_files(out))
    with fs.open_output_stream(f"{root}/stray.warc.gz", compression=None) as f:
        f.write(gzip.compress(W.record(999, "u", b"x", hashlib.sha256(b"x").hexdigest(), None)))
    assert W.read(spark, out).count() == len(PAGES)                    # a stray file is no part of the archive
    fs.delete_file(f"{root}/{names[0]}")
    with pytest.raises(FileNotFoundError):
        W.read(spark, out)
    out, fs, root = written()
    data = bytearray(fs.open_input_stream(f"{root}/{names[1]}", compression=None).read())
    data[len(data) // 2] ^= 1
    with fs.open_output_stream(f"{root}/{names[1]}", compression=None) as f:
        f.write(bytes(data))
    with pytest.raises(Exception, match="not the file of the manifest"):
        W.read(spark, out).count()
    out, fs, root = written()
    fs.delete_dir(f"{root}/_manifest")                                 # a crash between the renames and the manifest
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        W.read(spark, out)


def test_very_long_text(spark):
    out = scratch_path(spark, "warc")
    W.write(spark.createDataFrame([(1, "u", "é" * 3_000_000), (2, "u", "é" * 3_000_000)], SCHEMA), out)
    got = {r["page_id"]: (r["record_type"], r["payload_bytes"]) for r in W.read(spark, out).collect()}
    assert got == {1: ("response", 6_000_000), 2: ("revisit", 6_000_000)}


def test_manifest_is_kept(spark):
    out = scratch_path(spark, "warc")
    W.write(spark.createDataFrame(PAGES, SCHEMA), out)
    fs, root = W._fs(out)
    lines = [json.loads(x) for f in fs.get_file_info(pafs.FileSelector(f"{root}/_manifest")) if f.base_name.endswith(".json")
             for x in fs.open_input_stream(f.path).read().decode().splitlines()]
    assert sum(x["records"] for x in lines) == len(PAGES)
