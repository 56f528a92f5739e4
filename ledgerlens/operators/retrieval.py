"""Retrieval corpus (RET-1..9): rows rendered as documents, chunked, searched
top-k, and packed into a prompt.

Rendering and fixed-window chunking are column expressions (``concat``,
``sequence`` + ``posexplode`` + ``substring``) over whole texts.  The recursive
splitter is a small per-document helper run on Arrow batches.
Texts are searched by shared terms in an inverted index (``text_index``), given
vectors by one pass for few queries and in an index of cells for many
(``vector_index``)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import config as C
from ..functions.partitioning import ensure_parallelism
from ..config import LIMITS
from ..functions.columns import id_type
from ..session import scratch_path, stored
from .stats import py_ts_text
from .text_index import TextIndex
from .vector_index import VectorIndex

# --- rendering -----------------------------------------------------------

def py_float_text(c: Column) -> Column:
    """``str(float)`` as Python prints it: shortest round-trip digits, plain
    notation for 1e-4 <= |x| < 1e16, otherwise ``d.ddde+XX``."""
    s = c.cast("string")
    a = F.abs(c)
    plain = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", ".0")
    mant = F.regexp_replace(F.regexp_extract(s, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    exp = F.regexp_extract(s, r"E(-?[0-9]+)$", 1).cast("int")
    sci = F.concat(mant, F.lit("e"), F.when(exp < 0, "-").otherwise("+"), F.lpad(F.abs(exp).cast("string"), 2, "0"))
    return (F.when(c.isNull() | F.isnan(c), "nan")
            .when(c == float("inf"), "inf").when(c == float("-inf"), "-inf")
            .when(s.contains("E") & (a >= 1e-4) & (a < 1e16), plain)
            .when(s.contains("E"), sci).otherwise(s))


def value_text(df: DataFrame, c: str) -> Column:
    """A cell as pandas prints it inside a row: numbers, 'nan' for missing
    numbers, 'None' for missing text, 'NaT' for missing times."""
    t = df.schema[c].dataType
    col = F.col(c)
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return py_float_text(col.cast("double"))
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(py_ts_text(col), F.lit("NaT"))
    if isinstance(t, T.BooleanType):
        return F.when(col, "True").when(~col, "False").otherwise("nan")
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)):
        return F.coalesce(col.cast("string"), F.lit("nan"))
    return F.coalesce(col.cast("string"), F.lit("None"))


def row_documents(df: DataFrame, row_id: str, content_cols: Sequence[str] | None = None,
                  flag_col: str = "is_anomaly", score_col: str = "fraud_probability") -> DataFrame:
    """RET-1: ``Transaction ID: {id}`` + ``{col}: {value}`` lines, and the
    metadata (index, anomaly flag default false, risk score default 0, file)."""
    if content_cols is None:
        content_cols = [c for c in df.columns if c not in C.DOCUMENT_EXCLUDED]
    lines = [F.concat(F.lit(f"{c}: "), value_text(df, c), F.lit("\n")) for c in content_cols if c in df.columns]
    content = F.concat(F.lit("Transaction ID: "), F.col(row_id).cast("string"), F.lit("\n"), *lines)
    flag = F.coalesce(F.col(flag_col).cast("boolean"), F.lit(False)) if flag_col in df.columns else F.lit(False)
    score = F.col(score_col).cast("double") if score_col in df.columns else F.lit(0.0)
    meta = F.struct(F.col(row_id).cast(id_type(df, row_id)).alias("transaction_index"), flag.alias("is_anomaly"),
                    score.alias("risk_score"), F.lit(C.DOCUMENT_SOURCE_FILE).alias("source_file"))
    return df.select(F.col(row_id).cast(id_type(df, row_id)).alias("row_id"), content.alias("page_content"),
                     meta.alias("metadata"))


def row_text(df: DataFrame, row_id: str, text_columns: Sequence[str] | None = None) -> DataFrame:
    """RET-2: ``Transaction {idx}:`` + ``{col}: {value}`` lines."""
    cols = list(text_columns) if text_columns is not None else df.columns
    lines = [F.concat(F.lit(f"{c}: "), value_text(df, c), F.lit("\n")) for c in cols if c in df.columns]
    return df.select(F.col(row_id).cast(id_type(df, row_id)).alias("row_id"),
                     F.concat(F.lit("Transaction "), F.col(row_id).cast("string"), F.lit(":\n"), *lines)
                     .alias("text"))


def capped_rows(df: DataFrame, row_id: str, n: int = C.CORPUS_CAP) -> DataFrame:
    """The rows that survive the corpus cap, chosen on the id alone (a top-k
    over one column) before any text is rendered; the n ids are joined back
    with a broadcast (their count is n)."""
    ids = df.select(row_id).orderBy(row_id).limit(n)
    return df.join(F.broadcast(ids), row_id, "left_semi")


# --- chunking ------------------------------------------------------------

def chunk_fixed(df: DataFrame, id_col: str, text_col: str, size: int = C.CHUNK_SIZE,
                overlap: int = C.CHUNK_OVERLAP) -> DataFrame:
    """RET-4a: windows of ``size`` characters starting every size-overlap
    characters, until one reaches the end of the text; an empty text has none."""
    step = size - overlap
    n = F.length(text_col)
    count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / F.lit(float(step))).cast("int") + 1)
    return (ensure_parallelism(df.select(id_col, text_col)).where(n > 0)
            .select(id_col, text_col, F.posexplode(F.sequence(F.lit(0), count - 1)).alias("chunk_no", "_i"))
            .select(F.col(id_col), F.col("chunk_no").cast("bigint").alias("chunk_no"),
                    F.expr(f"substring(`{text_col}`, _i * {step} + 1, {size})").alias("chunk")))


def _ends(text: str, lo: int, hi: int, separator: str) -> list[int]:
    """Ends of the pieces of ``text[lo:hi]``; a piece after the first begins with the separator."""
    if not separator:
        return list(range(lo + 1, hi + 1))
    out, at = [], text.find(separator, lo, hi)
    while at >= 0:
        if at > lo:
            out.append(at)
        at = text.find(separator, at + len(separator), hi)
    return [*out, hi]


def _merged(start: int, ends: list[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Neighbouring pieces joined as long as ``size`` allows.  A chunk begins with
    as many whole pieces of the one before as ``overlap`` and its next piece allow."""
    starts, first = [start, *ends[:-1]], 0
    for i, end in enumerate(ends):
        if i > first and end - starts[first] > size:
            yield starts[first], ends[i - 1]
            while first < i and (starts[i] - starts[first] > overlap or end - starts[first] > size):
                first += 1
    yield starts[first], ends[-1]


def _chunk_spans(text: str, lo: int, hi: int, size: int, overlap: int, separators: Sequence[str]) -> Iterator[tuple[int, int]]:
    level = next((n for n, s in enumerate(separators) if not s or text.find(s, lo, hi) >= 0), len(separators) - 1)
    finer, run, start, at = separators[level + 1:], [], lo, lo
    for end in _ends(text, lo, hi, separators[level]):
        if end - at < size:
            run.append(end)
        else:                                                       # too long: split by the next separators
            if run:
                yield from _merged(start, run, size, overlap)
            yield from _chunk_spans(text, at, end, size, overlap, finer) if finer else [(at, end)]
            run, start = [], end
        at = end
    if run:
        yield from _merged(start, run, size, overlap)


def split_recursive(text: str | None, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP,
                    separators: Sequence[str] = tuple(C.SPLIT_SEPARATORS)) -> list[str]:
    """Chunks by the recursive rule: a text is cut before each place of the first
    separator that it holds (the empty one cuts everywhere); pieces shorter than
    ``size`` are merged with their neighbours up to ``size``, whole pieces of up to
    ``overlap`` characters being repeated in the next chunk; a longer piece is cut
    by the separators that follow.  Chunks lose the white space around them, blank
    ones are left out; a null text has none."""
    spans = _chunk_spans(text, 0, len(text), size, overlap, separators) if text else ()
    return [piece for a, b in spans if (piece := text[a:b].strip())]


#: Chunks that a task passes on at once.
CHUNKS_SENT = 2_000


def chunk_recursive(df: DataFrame, id_col: str, text_col: str, size: int = C.CHUNK_SIZE,
                    overlap: int = C.CHUNK_OVERLAP) -> DataFrame:
    """RET-4b: separator-aware chunks, one row each.  A task splits one text at a
    time and passes chunks on as soon as there are some, so that its Python holds
    a batch of texts but never their chunks as well."""
    given = df.select(id_col, text_col)
    schema = T.StructType([given.schema[id_col], T.StructField("chunk_no", T.LongType()), T.StructField("chunk", T.StringType())])
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(at: list, ids: pa.Array, numbers: list, chunks: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())).cast(out.types[0]), pa.array(numbers, out.types[1]), pa.array(chunks, out.types[2])], schema=out)

        for b in batches:
            ids, texts = b.column(0), b.column(1)
            at, numbers, chunks = [], [], []
            for i in range(b.num_rows):
                for n, piece in enumerate(split_recursive(texts[i].as_py(), size, overlap)):
                    at.append(i)
                    numbers.append(n)
                    chunks.append(piece)
                    if len(at) == CHUNKS_SENT:
                        yield batch(at, ids, numbers, chunks)
                        at, numbers, chunks = [], [], []
            yield batch(at, ids, numbers, chunks)

    return ensure_parallelism(given).mapInArrow(run, schema)


# --- vectors -------------------------------------------------------------

def centroid(df: DataFrame, vec_col: str, group_col: str | None = None) -> DataFrame:
    """Mean vector (per group): element-wise average through posexplode and a
    grouped average (partial aggregation), reassembled in position order."""
    keys = [group_col] if group_col else []
    long = df.select(*keys, F.posexplode(vec_col).alias("pos", "x"))
    means = long.groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("query"))


def top_k(items: DataFrame, item_id: str | Sequence[str], vec_col: str, queries: DataFrame,
          query_id: str, query_vec: str = "query", k: int = C.RETRIEVAL_K,
          carry: Sequence[str] = (), query_carry: Sequence[str] = ()) -> DataFrame:
    """RET-5/6: the k nearest items (squared L2, ties by item id) per query.

    Up to ``LIMITS.query_block`` queries are held by every task, which reads its
    items once and passes on k hits for each query; more queries are searched in
    an index (``vector_index``) built for them.  Items and queries without a
    vector, or with one of another length, have no hits.  What ``carry`` and
    ``query_carry`` name is joined to the stored hits."""
    ids = [item_id] if isinstance(item_id, str) else list(item_id)
    asked = queries.select(query_id, F.col(query_vec).cast("array<double>").alias("_q"))
    held = asked.limit(LIMITS.query_block + 1).collect()
    if len(held) > LIMITS.query_block:
        path = scratch_path(items.sparkSession, "vector-index")
        hits = VectorIndex.build(items.select(*ids, vec_col), ids, vec_col, path).search(asked, query_id, "_q", k)
    else:
        hits = _scan(items.select(*ids, F.col(vec_col).cast("array<double>").alias("_v")), ids, asked.schema[query_id], held, k)
    if carry or query_carry:
        # stored, so that the planner knows how few hits there are before it joins texts to them
        hits = stored(hits, "hits")
    if carry:
        hits = items.select(*ids, *carry).join(hits, ids)
    if query_carry:
        hits = hits.join(queries.select(query_id, *query_carry).dropDuplicates([query_id]), query_id)
    return hits.select(query_id, *query_carry, *ids, *carry, "distance", "rank")


def _scan(items: DataFrame, ids: list[str], query_field: T.StructField, queries: list, k: int) -> DataFrame:
    """The k nearest of each task's items to each of a few queries, then of all."""
    spark = items.sparkSession
    usable = [(n, np.array(r["_q"], np.float64)) for n, r in enumerate(queries) if r["_q"] is not None and None not in r["_q"]]
    names = spark.createDataFrame([(n, r[0]) for n, r in enumerate(queries)], T.StructType([T.StructField("_n", T.IntegerType()), T.StructField(query_field.name, query_field.dataType)]))
    kinds = ", ".join(f"`{c}` {items.schema[c].dataType.simpleString()}" for c in ids)
    schema = f"_n int, {kinds}, distance double"
    out = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def order(hit: tuple) -> tuple:
        return hit[-1], *((v is not None, v) for v in hit[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {n: [] for n, _ in usable}
        for b in batches:
            vec, keys = b.column("_v"), [b.column(c) for c in ids]
            sizes = pc.list_value_length(vec)
            for n, q in usable:
                there = np.flatnonzero(pc.fill_null(pc.equal(sizes, len(q)), False).to_numpy(zero_copy_only=False))
                if not len(there):
                    continue
                x = vec.take(pa.array(there)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(there), len(q))
                d = ((x - q) ** 2).sum(axis=1)                      # NaN for what has no distance
                limit = min(np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf, best[n][-1][-1] if len(best[n]) == k else np.inf)
                near = np.flatnonzero(np.isfinite(d) & ((d <= limit) | np.isnan(limit)))
                new = zip(*(c.take(pa.array(there[near])).to_pylist() for c in keys), d[near].tolist())
                best[n] = sorted([*best[n], *new], key=order)[:k]
        rows = [(n, *hit) for n, hits in best.items() for hit in hits]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(out), out.types)], schema=out)

    hits = ensure_parallelism(items).mapInArrow(run, schema)
    w = Window.partitionBy("_n").orderBy("distance", *ids)
    hits = hits.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)
    return hits.join(F.broadcast(names), "_n").select(query_field.name, *ids, "distance", "rank")       # query_block rows


def search_texts(docs: DataFrame, ids: Sequence[str], text_col: str, queries: DataFrame, query_id: str, query_text: str, k: int = C.RETRIEVAL_K) -> DataFrame:
    """RET-5..7 on texts: ``query_id, query_text, ids..., text_col, score, rank`` of
    each query's k best rows, by the terms that they share (``text_index``)."""
    spark = docs.sparkSession
    index = TextIndex.build(docs.select(*ids, text_col), ids, text_col, scratch_path(spark, "text-index"))
    hits = index.search(queries, query_id, query_text, k).withColumnRenamed("text", text_col)
    return hits.join(queries.select(query_id, query_text).dropDuplicates([query_id]), query_id).select(query_id, query_text, *ids, text_col, "score", "rank")


def pack_prompt(hits: DataFrame, query_id: str, query_text: str, content_col: str,
                template: str = C.QA_PROMPT) -> DataFrame:
    """RET-7: the k contents in rank order joined by a blank line ("stuff"),
    placed into the prompt template with the question.  Bounded by k."""
    java_tpl = template.replace("%", "%%").replace("{context}", "%1$s").replace("{question}", "%2$s")
    g = hits.groupBy(query_id, query_text).agg(
        F.array_sort(F.collect_list(F.struct("rank", content_col))).alias("_docs"))
    ctx = F.array_join(F.transform("_docs", lambda s: s[content_col]), "\n\n")
    return g.select(query_id, query_text, F.format_string(java_tpl, ctx, F.col(query_text)).alias("prompt"),
                    F.size("_docs").cast("bigint").alias("n_sources"))
