"""Deterministic sharded WARC writer and reader.

Records are dealt to shards by ranges of their id, cut from exact histograms
of bytes: crowded bins are counted again in finer ones, down to single ids, so
ids may lie anywhere, and the same rows always give the same files.  They are sorted, and written as
one gzip member each.  Files roll at a compressed size.  A task writes under a
temporary name of its own attempt and reports a manifest row; only manifest
rows of successful attempts are stored, and the commit renames exactly those
files and then writes the manifest.  The reader goes by the manifest alone: files that it
doesn't name are no part of the archive, and those that it names must be there with their
digests.  Headers and digests are made anew from the payload.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import sized, store

#: Payloads with fewer bytes are never written as revisits.
REVISIT_BYTES = 100
SHARD_BYTES = 32 << 20
ROLL_BYTES = 8 << 20
#: Bins of an id histogram that cuts the shards, at most; a few of them reach the driver one after the other.
ID_BINS = 16384
#: Ranges that are cut finer at once, so shards are at most about as many.
MOST_SHARDS = 4096
DATE = "1970-01-01T00:00:00Z"
_MANIFEST = "shard int, seq int, part string, name string, records long, bytes long, sha256 string"


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def _clean(value: str) -> str:
    """A header value on one line: control characters and spaces are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str = DATE) -> bytes:
    """One WARC record, not compressed.  A revisit carries no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    key = f"{page_id}|{url}|{digest}|{refers_to}"
    head = [("WARC-Type", "response" if refers_to is None else "revisit"),
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", _clean(url)))
    if page_id is not None:
        head.append(("X-Page-Id", page_id))
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-Id", refers_to)]
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", len(payload)),
             ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
             ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def members(data: bytes) -> Iterator[bytes]:
    """The contents of a file's gzip members, one at a time."""
    view, at, step = memoryview(data), 0, 1 << 16
    while at < len(view):
        unzip, parts = zlib.decompressobj(31), []
        while not unzip.eof:
            piece = view[at:at + step]
            if not piece:
                raise ValueError("truncated archive")
            parts.append(unzip.decompress(piece))
            at += len(piece) - len(unzip.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record; lengths and digests must agree."""
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    block = raw[end + 4:end + 4 + int(head["Content-Length"])]
    if len(raw) != end + 4 + len(block) + 4 or f"sha256:{hashlib.sha256(block).hexdigest()}" != head["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {head.get('WARC-Record-ID')}")
    payload = block[block.index(b"\r\n\r\n") + 4:]
    if head["WARC-Type"] == "response" and f"sha256:{hashlib.sha256(payload).hexdigest()}" != head["WARC-Payload-Digest"]:
        raise ValueError(f"damaged payload {head.get('WARC-Record-ID')}")
    return head, payload


def _crowded(light: DataFrame, most: int) -> list[tuple[int, int, int]]:
    """Ranges of ids, ``(first, last, bytes)`` in order, none with more than ``most``
    bytes but for single ids.  Null ids are not counted here.

    Ids are counted by their leading bits; ranges that hold too much are counted
    by some more bits in the next round, a grouped job over those rows alone."""
    lo, hi = light.agg(F.min("page_id"), F.max("page_id")).first()
    if lo is None:
        return []
    offset = F.expr(f"cast(page_id as decimal(20,0)) - ({lo})")
    shift, done, open_ = max(0, (hi - lo).bit_length() - (ID_BINS.bit_length() - 1)), [], None
    while True:
        rows = light.where("page_id is not null").withColumn("prefix", (offset / F.lit(1 << shift).cast("decimal(20,0)")))
        rows = rows.withColumn("prefix", F.floor("prefix").cast("decimal(20,0)"))
        if open_ is not None:
            above = light.sparkSession.createDataFrame([(Decimal(p),) for p in open_], "parent decimal(20,0)")
            rows = rows.withColumn("parent", F.floor(F.col("prefix") / F.lit(1 << bits).cast("decimal(20,0)")).cast("decimal(20,0)")).join(F.broadcast(above), "parent")
        bins = [(int(r["prefix"]), int(r["w"])) for r in rows.groupBy("prefix").agg(F.sum("w").alias("w")).collect()]
        open_ = sorted(p for p, w in bins if w > most and shift > 0)
        again = set(open_)
        done += [(lo + (p << shift), min(hi, lo + ((p + 1) << shift) - 1), w) for p, w in bins if p not in again]
        if not open_:
            return sorted(done)
        bits = min(shift, max(1, (ID_BINS // len(open_)).bit_length() - 1))
        shift -= bits


def _shard_cuts(light: DataFrame, shard_bytes: int) -> tuple[list[int], list[int], int]:
    """``(first ids, parts, parts of the null id)``: the shards' first ids, and over
    how many shards each range's rows are dealt by their digests (1 but for single ids of very many rows)."""
    light = light.withColumn("w", F.col("n_bytes") + 512)
    total, nulls = light.agg(F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("page_id").isNull(), F.col("w"))), F.lit(0))).first()
    most = max(shard_bytes, -(-int(total) // MOST_SHARDS))
    starts, parts, filled = [], [], most
    for first, _, w in _crowded(light, most):
        if filled + (w if w > most else 0) >= most:
            starts.append(first)
            parts.append(max(1, -(-w // most)))
            filled = w if w <= most else most
        else:
            filled += w
    return starts, parts, max(1, -(-int(nulls) // most)) if nulls else 0


def _shard_column(light: DataFrame, shard_bytes: int):
    """A column with the shard of ``page_id`` and ``digest``, and the number of shards."""
    starts, parts, null_parts = _shard_cuts(light, shard_bytes)
    cuts, sizes = np.array(starts, np.int64), np.array([*parts, null_parts], np.int64)
    firsts = np.cumsum(sizes) - sizes

    @F.pandas_udf("int")
    def shard(page_id: pd.Series, digest: pd.Series) -> pd.Series:
        known = page_id.notna().to_numpy()
        at = np.full(len(page_id), len(cuts))
        at[known] = np.searchsorted(cuts, page_id[known].astype(np.int64).to_numpy(), "right") - 1
        part = np.array([int(d[:8], 16) for d in digest], np.int64)
        return pd.Series((firsts[at] + (part * sizes[at] >> 32)).astype(np.int32))

    return shard(F.col("page_id"), F.col("digest")), max(1, int(sizes.sum()))


def write(pages: DataFrame, out_dir: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, date: str = DATE) -> DataFrame:
    """Write a record for each row to ``out_dir`` and return the committed manifest.

    Among rows with equal payloads of at least ``REVISIT_BYTES`` bytes those
    with the smallest id are responses and the others revisit it.  A null html
    is an empty payload; a null url has no target header; a null id has no id
    header and is never a revisit's target or a revisit.  Repeated rows give
    repeated records.  An empty table writes no file.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    light = store(rows.select("page_id", "digest", F.octet_length("payload").cast("long").alias("n_bytes")), "warc-light")
    first = light.where((F.col("n_bytes") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).groupBy("digest").agg(
        F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    # stored, so that its size decides whether payloads must move for the join
    revisits = store(light.join(first, "digest").where("page_id > refers_to")
                     .select(F.col("page_id").alias("rid"), F.col("digest").alias("rdigest"), "refers_to").distinct(), "warc-revisits")
    shard, n_shards = _shard_column(light, shard_bytes)
    dealt = (rows.join(revisits, (F.col("page_id") == F.col("rid")) & (F.col("digest") == F.col("rdigest")), "left")
             .select("page_id", "url", "payload", "digest", "refers_to", shard.alias("shard"))
             .repartitionById(n_shards, "shard").sortWithinPartitions("shard", "page_id", "url", "digest"))
    out_schema = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("part", pa.string()), ("name", pa.string()),
                            ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])

    def write_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(out_dir)
        fs.create_dir(f"{root}/_parts", recursive=True)
        done: list[tuple] = []
        open_: dict = {}

        def close() -> None:
            if open_:
                open_["file"].close()
                done.append((open_["shard"], open_["seq"], open_["part"], f"shard-{open_['shard']:06d}-{open_['seq']:05d}.warc.gz",
                             open_["n"], open_["size"], open_["sha"].hexdigest()))
                open_.clear()

        last = (-1, -1)
        for batch in batches:
            for page_id, url, payload, digest, refers_to, sh in zip(*(c.to_pylist() for c in batch.columns)):
                if open_ and (open_["shard"] != sh or open_["size"] >= roll_bytes):
                    close()
                if not open_:
                    seq = last[1] + 1 if last[0] == sh else 0
                    last = (sh, seq)
                    part = f"_parts/{sh}-{seq}-{uuid.uuid4().hex}"
                    open_.update(shard=sh, seq=seq, part=part, n=0, size=0, sha=hashlib.sha256(), file=fs.open_output_stream(f"{root}/{part}", compression=None))
                zipper = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = zipper.compress(record(page_id, url, payload, digest, refers_to, date)) + zipper.flush()
                open_["file"].write(data)
                open_["sha"].update(data)
                open_["n"] += 1
                open_["size"] += len(data)
        close()
        cols = list(zip(*done)) if done else [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out_schema)], schema=out_schema)

    manifest = store(dealt.mapInArrow(write_task, _MANIFEST), "warc-manifest")

    def commit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(out_dir)
        for batch in batches:
            for part, name in zip(batch.column("part").to_pylist(), batch.column("name").to_pylist()):
                if fs.get_file_info(f"{root}/{part}").type != pafs.FileType.NotFound:   # else a former attempt has renamed it
                    fs.move(f"{root}/{part}", f"{root}/{name}")
            yield batch

    committed = manifest.mapInArrow(commit_task, _MANIFEST)
    committed.drop("part").coalesce(1).write.json(f"{out_dir}/_manifest")     # a short row for each file
    fs, root = _fs(out_dir)
    if fs.get_file_info(f"{root}/_parts").type != pafs.FileType.NotFound:
        fs.delete_dir(f"{root}/_parts")                                      # leftovers of failed attempts
    return manifest.drop("part")


def read(spark: SparkSession, out_dir: str) -> DataFrame:
    """The records of committed archives: ``page_id, url, record_type, refers_to,
    payload_bytes, payload_digest, payload`` (null for revisits).

    The manifest says which files are read.  A folder without a manifest, a file
    that is missing and one with another digest or length raise an error, and so does a damaged
    record; other files in the folder are left alone."""
    manifest = store(spark.read.schema(_MANIFEST).json(f"{out_dir}/_manifest").select("name", "records", "bytes", "sha256"), "warc-read")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(out_dir).withColumn("name", F.element_at(F.split("path", "/"), -1))
    missing = manifest.join(found.select("name"), "name", "left_anti").limit(3).collect()
    if missing:
        raise FileNotFoundError(f"{out_dir}: files of the manifest are missing: {', '.join(r['name'] for r in missing)}")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, name, records, size, sha256 in zip(batch.column(0), *(c.to_pylist() for c in batch.columns[1:])):
                rows, held, seen, data = [], 0, 0, content.as_buffer()
                if len(data) != size or hashlib.sha256(data).hexdigest() != sha256:
                    raise ValueError(f"{name} is not the file of the manifest")
                for raw in members(data):
                    seen += 1
                    head, payload = parse(raw)
                    page, to, kind = head.get("X-Page-Id"), head.get("X-Refers-To-Page-Id"), head["WARC-Type"]
                    rows.append((int(page) if page is not None else None, head.get("WARC-Target-URI"), kind, int(to) if to is not None else None,
                                 int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:"),
                                 payload if kind == "response" else None))
                    held += len(payload)
                    if held > 16 << 20:
                        yield _batch(rows, schema)
                        rows, held = [], 0
                if seen != records:
                    raise ValueError(f"{name} holds {seen} records, the manifest says {records}")
                yield _batch(rows, schema)

    # the files stay where they are, if the manifest is not very long
    files = found.select("name", "content").join(sized(manifest), "name").select("content", "name", "records", "bytes", "sha256")
    return files.mapInArrow(read_task, "page_id long, url string, record_type string, refers_to long, "
                                       "payload_bytes long, payload_digest string, payload binary")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
