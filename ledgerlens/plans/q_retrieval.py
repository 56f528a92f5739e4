"""Registered retrieval queries (RET-1..9, SNK-4, SRC-9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions.exprs import r6
from ..operators import anomaly as A
from ..operators import retrieval as RT
from ..operators.vector_index import VectorIndex
from ..session import scratch_path
from ..sources.collection import Collection
from ..sources.views import SQL_SCORED, SQL_TXN, read_table, scored, txn
from .catalog import register
from .q_anomaly import _f_sql, _z_sql
from .q_stats import PY_TS, q_anomaly_report
from . import q_stats

def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_dist(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::double - z[2]::double) ** 2))"


def sql_chunks(src: str, id_col: str, text_col: str) -> str:
    return f"""chunks AS (
  SELECT {id_col}, i AS chunk_no, substr({text_col}, cast(i * 800 + 1 AS bigint), 1000) AS chunk FROM (
    SELECT {id_col}, {text_col},
           unnest(range(0, CASE WHEN length({text_col}) <= 1000 THEN 1
                                ELSE cast(ceil((length({text_col}) - 1000) / 800.0) AS bigint) + 1 END)) AS i
    FROM {src}))"""


# --- RET-1..3 on the transaction table ------------------------------------

def _flagged_scored(spark, sf_dir):
    s = scored(spark, sf_dir).drop("anomaly_raw", "fraud_prediction")
    return A.flag_anomalies(s)


SQL_DOCS = SQL_SCORED + f""", {_z_sql('scored')}, {_f_sql('scored')},
flagged AS (SELECT s.*, coalesce(z.z > 3, false) OR (u.customer_id IS NOT NULL) AS is_anomaly
            FROM scored s JOIN z ON z.row_id = s.transaction_id LEFT JOIN unusual u ON u.customer_id = s.customer_id),
docs AS (SELECT transaction_id AS row_id,
  'Transaction ID: ' || transaction_id || chr(10) || 'transaction_id: ' || transaction_id || chr(10)
  || 'customer_id: ' || customer_id || chr(10) || 'amount: ' || cast(amount AS varchar) || chr(10)
  || 'category: ' || category || chr(10) || 'transaction_date: ' || {PY_TS.format(c='transaction_date')} || chr(10)
  || 'is_fraud: ' || is_fraud || chr(10) AS page_content,
  transaction_id AS transaction_index, is_anomaly, fraud_probability AS risk_score,
  'transactions.csv' AS source_file FROM flagged)"""


@register("row_documents", f"""WITH {SQL_DOCS}
SELECT row_id, page_content, transaction_index, is_anomaly, round(risk_score, 6) AS risk_score, source_file FROM docs""")
def q_row_documents(spark, sf_dir):
    d = RT.row_documents(_flagged_scored(spark, sf_dir), "transaction_id")
    return d.select("row_id", "page_content", "metadata.transaction_index", "metadata.is_anomaly",
                    r6(F.col("metadata.risk_score")).alias("risk_score"), "metadata.source_file")


@register("row_text", f"""WITH {SQL_TXN}
SELECT transaction_id AS row_id,
  'Transaction ' || transaction_id || ':' || chr(10) || 'transaction_id: ' || transaction_id || chr(10)
  || 'customer_id: ' || customer_id || chr(10) || 'amount: ' || cast(amount AS varchar) || chr(10)
  || 'category: ' || category || chr(10) || 'transaction_date: ' || {PY_TS.format(c='transaction_date')} || chr(10)
  || 'is_fraud: ' || is_fraud || chr(10) AS text FROM txn""")
def q_row_text(spark, sf_dir):
    return RT.row_text(txn(spark, sf_dir), "transaction_id")


@register("corpus_cap", f"""WITH {SQL_DOCS}
SELECT row_id, page_content FROM docs ORDER BY row_id LIMIT 1000""")
def q_corpus_cap(spark, sf_dir):
    rows = RT.capped_rows(_flagged_scored(spark, sf_dir), "transaction_id")
    return RT.row_documents(rows, "transaction_id").select("row_id", "page_content")


# --- RET-4 chunking over whole documents ----------------------------------

SQL_DOC_CHUNKS = sql_chunks("documents", "doc_id", "text")


@register("chunk_fixed", f"WITH {SQL_DOC_CHUNKS}\nSELECT doc_id, chunk_no, chunk FROM chunks")
def q_chunk_fixed(spark, sf_dir):
    return RT.chunk_fixed(read_table(spark, sf_dir, "documents"), "doc_id", "text")


@register("chunk_recursive")
def q_chunk_recursive(spark, sf_dir):
    return RT.chunk_recursive(read_table(spark, sf_dir, "documents"), "doc_id", "text")


# --- SNK-4, SRC-9: the stored collection ----------------------------------

def _split(df, id_col, text_col):
    return RT.chunk_fixed(df, id_col, text_col)


def _revised(spark, sf_dir):
    """Every tenth document with another text."""
    d = read_table(spark, sf_dir, "documents").where("doc_id % 10 = 0")
    return d.select("doc_id", F.concat(F.lit("Revised merchant record, volumes unusual.\n"), "text").alias("text"))


SQL_REVISED = """revised AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'Revised merchant record, volumes unusual.' || chr(10) || text ELSE text END AS text
  FROM documents WHERE doc_id % 7 <> 1), """ + sql_chunks("revised", "doc_id", "text")


def _reopened(spark, sf_dir):
    """All documents put into a collection, a tenth replaced, a seventh removed, opened again."""
    root, docs = scratch_path(spark, "collections"), read_table(spark, sf_dir, "documents")
    first = Collection.create(spark, root, C.COLLECTION_NAME).put(docs, "doc_id", "text", _split)
    first.put(_revised(spark, sf_dir), "doc_id", "text", _split).remove(docs.where("doc_id % 7 = 1"), "doc_id")
    return Collection.open(spark, root, C.COLLECTION_NAME)


@register("corpus_roundtrip", f"WITH {SQL_DOC_CHUNKS}\nSELECT doc_id, chunk_no, chunk FROM chunks")
def q_corpus_roundtrip(spark, sf_dir):
    root = scratch_path(spark, "collections")
    Collection.create(spark, root, C.COLLECTION_NAME).put(read_table(spark, sf_dir, "documents"), "doc_id", "text", _split)
    return Collection.open(spark, root, C.COLLECTION_NAME).chunks()


@register("collection_chunks", f"WITH {SQL_REVISED}\nSELECT doc_id, chunk_no, chunk FROM chunks")
def q_collection_chunks(spark, sf_dir):
    return _reopened(spark, sf_dir).chunks()


# --- RET-5..9 search ------------------------------------------------------

SQL_EMB_LONG = """ex AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings)"""


@register("vector_topk", f"""WITH {SQL_EMB_LONG},
q AS (SELECT list(m ORDER BY pos) AS query FROM (SELECT pos, avg(x::double) AS m FROM ex GROUP BY pos)),
d AS (SELECT vec_id, {sql_dist('embedding', 'query')} AS distance FROM embeddings, q)
SELECT vec_id, row_number() OVER (ORDER BY distance, vec_id) AS rank, round(distance, 6) AS distance
FROM d ORDER BY distance, vec_id LIMIT 5""")
def q_vector_topk(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    q = RT.centroid(e, "embedding").withColumn("query_id", F.lit(0))
    hits = RT.top_k(e, "vec_id", "embedding", q, "query_id")
    return hits.select("vec_id", "rank", r6(F.col("distance")).alias("distance"))


@register("vector_topk_batch", f"""WITH {SQL_EMB_LONG},
q AS (SELECT label AS query_label, list(m ORDER BY pos) AS query
      FROM (SELECT label, pos, avg(x::double) AS m FROM ex GROUP BY label, pos) GROUP BY label),
d AS (SELECT query_label, vec_id, {sql_dist('embedding', 'query')} AS distance FROM embeddings, q)
SELECT query_label, vec_id, rank, round(distance, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_label ORDER BY distance, vec_id) AS rank FROM d) WHERE rank <= 5""")
def q_vector_topk_batch(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    q = RT.centroid(e, "embedding", "label").withColumnRenamed("label", "query_label")
    hits = RT.top_k(e, "vec_id", "embedding", q, "query_label")
    return hits.select("query_label", "vec_id", "rank", r6(F.col("distance")).alias("distance"))


SQL_PAIRS = f"""SELECT a.vec_id AS query_id, b.vec_id, {sql_dist('a.embedding', 'b.embedding')} AS distance
  FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0"""


@register("vector_index_topk", f"""WITH d AS ({SQL_PAIRS})
SELECT query_id, vec_id, rank, round(distance, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) WHERE rank <= 5""")
def q_vector_index_topk(spark, sf_dir):
    """An index of all vectors, opened again; every hundredth vector is a query."""
    e = read_table(spark, sf_dir, "embeddings")
    path = VectorIndex.build(e, ["vec_id"], "embedding", scratch_path(spark, "vector-index")).path
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = VectorIndex.open(spark, path).search(asked, "query_id", "embedding", C.RETRIEVAL_K)
    return hits.select("query_id", "vec_id", "rank", r6(F.col("distance")).alias("distance"))


def _questions(spark):
    return spark.createDataFrame(list(enumerate(C.RUN_QUESTIONS)), "query_id int, query string")


def _doc_hits(spark, sf_dir):
    chunks = RT.chunk_fixed(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return RT.search_texts(chunks, ["doc_id", "chunk_no"], "chunk", _questions(spark), "query_id", "query")


SQL_QUESTIONS = "qs AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {sql_str(q)})" for i, q in enumerate(C.RUN_QUESTIONS)) + ") t(query_id, query))"


def _sql_terms(keys: str, text: str, table: str) -> str:
    return f"""SELECT {keys}, b, count(*) AS c FROM (
    SELECT {keys}, cast('0x' || substr(md5(word), 1, 8) AS bigint) % 262144 AS b FROM (
      SELECT {keys}, unnest(list_filter(regexp_split_to_array(lower({text}), '[\\x00-\\x2F:-@\\[-`{{-\\x7F]+'), lambda x: x <> '')) AS word FROM {table})) GROUP BY {keys}, b"""


def sql_hits(k: int = C.RETRIEVAL_K) -> str:
    """CTEs from ``chunks(doc_id, chunk_no, chunk)`` to ``hits``: every text scored with every question."""
    return f"""{SQL_QUESTIONS},
txt AS (SELECT DISTINCT chunk FROM chunks), nn AS (SELECT count(*) AS n FROM txt),
tf AS ({_sql_terms('chunk', 'chunk', 'txt')}), wn AS (SELECT chunk, sum(c) AS n FROM tf GROUP BY chunk),
idf AS (SELECT b, ln((SELECT n FROM nn) + 1.0) - ln(count(*) + 1.0) AS i FROM tf GROUP BY b),
qtf AS ({_sql_terms('query_id, query', 'query', 'qs')}),
sc AS (SELECT query_id, query, tf.chunk, round(sum(qtf.c * i * i * tf.c / sqrt(wn.n)), 9) AS score
       FROM qtf JOIN tf ON tf.b = qtf.b JOIN idf ON idf.b = tf.b JOIN wn ON wn.chunk = tf.chunk GROUP BY query_id, query, tf.chunk),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_no) AS rank FROM (
           SELECT qs.query_id, qs.query, doc_id, chunk_no, chunks.chunk, coalesce(score, 0) AS score
           FROM qs CROSS JOIN chunks LEFT JOIN sc ON sc.chunk = chunks.chunk AND sc.query_id = qs.query_id)) WHERE rank <= {k})"""


@register("retrieval_result", f"""WITH {SQL_DOC_CHUNKS}, {sql_hits()}
SELECT query_id, query, rank, doc_id, chunk_no, round(score, 6) AS score FROM hits""")
def q_retrieval_result(spark, sf_dir):
    return _doc_hits(spark, sf_dir).select("query_id", "query", "rank", "doc_id", "chunk_no", r6(F.col("score")).alias("score"))


SQL_PROMPTS = f"""SELECT query_id, query,
       printf({sql_str(C.QA_PROMPT.replace('{context}', '%s').replace('{question}', '%s'))},
              string_agg(chunk, chr(10) || chr(10) ORDER BY rank), query) AS prompt,
       count(*) AS n_sources
FROM hits GROUP BY query_id, query"""


@register("packed_prompt", f"WITH {SQL_DOC_CHUNKS}, {sql_hits()}\n{SQL_PROMPTS}")
def q_packed_prompt(spark, sf_dir):
    return RT.pack_prompt(_doc_hits(spark, sf_dir), "query_id", "query", "chunk")


@register("collection_search", f"""WITH {SQL_REVISED}, {sql_hits()}
SELECT query_id, rank, doc_id, chunk_no, round(score, 6) AS score, chunk FROM hits""")
def q_collection_search(spark, sf_dir):
    hits = _reopened(spark, sf_dir).search(_questions(spark), "query_id", "query", C.RETRIEVAL_K)
    return hits.select("query_id", "rank", "doc_id", "chunk_no", r6(F.col("score")).alias("score"), F.col("text").alias("chunk"))


def _report_sql_body() -> str:
    sql = q_stats.ORACLE_ANOMALY_REPORT
    head, _, select = sql.rpartition("\nSELECT CASE WHEN na = 0")
    return head + ",\nreport_doc AS (SELECT 0 AS doc_id, CASE WHEN na = 0" + select + ")"


@register("report_document", _report_sql_body() + ", " + sql_chunks("report_doc", "doc_id", "report")[0:]
          + "\nSELECT doc_id, chunk_no, chunk FROM chunks")
def q_report_document(spark, sf_dir):
    rep = q_anomaly_report(spark, sf_dir).select(F.lit(0).cast("bigint").alias("doc_id"), F.col("report"))
    return RT.chunk_fixed(rep, "doc_id", "report")


@register("page_prompt", _report_sql_body() + ", " + sql_chunks("report_doc", "doc_id", "report") + f", {sql_hits(C.PAGE_RETRIEVAL_K)}\n{SQL_PROMPTS}")
def q_page_prompt(spark, sf_dir):
    """RET-8: the questions asked of the report, with the page's own depth."""
    rep = q_anomaly_report(spark, sf_dir).select(F.lit(0).cast("bigint").alias("doc_id"), F.col("report"))
    chunks = RT.chunk_fixed(rep, "doc_id", "report")
    hits = RT.search_texts(chunks, ["doc_id", "chunk_no"], "chunk", _questions(spark), "query_id", "query", C.PAGE_RETRIEVAL_K)
    return RT.pack_prompt(hits, "query_id", "query", "chunk")
