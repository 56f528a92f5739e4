"""The registered queries of the operators, with production parameters, over
the whole given tables; ``ORACLE`` holds DuckDB twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path, table_path
from . import (bpe_codec, cover_pairs, hard_negatives, html_tree, kd_shards, language_id, secret_ledger, signature_join, site_quality,
               template_leaks, token_counts, token_links, warc_shards)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _components_sql(nodes: str, links: str) -> str:
    """CTE ``comp(node, component)``: links are (a, b) in both directions."""
    return f"""reach(node, other) AS (
  SELECT node, node FROM ({nodes}) UNION SELECT r.node, l.b FROM reach r JOIN ({links}) l ON l.a = r.other),
comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""


SQL_COVER = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
hit AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
        WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
{_components_sql("SELECT vec_id AS node FROM v", "SELECT a, b FROM hit")}
SELECT vec_id, coalesce(n, 0) AS n_links, component AS component_id, vec_id = component AS kept
FROM v JOIN comp ON comp.node = vec_id LEFT JOIN (SELECT a, count(*) AS n FROM hit GROUP BY a) ON a = vec_id"""

SQL_JACCARD = f"""WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS sh
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
hit AS (SELECT a, b FROM pair JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
{_components_sql("SELECT doc_id AS node FROM w", "SELECT a, b FROM hit")}
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component AS component_id
FROM w JOIN comp ON comp.node = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id"""


def _secrets_sql() -> str:
    """Each rule's matches from one pass, their places from the lengths of the gaps between them."""
    rules = secret_ledger.RULES
    plus = {"access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}                        # with a length check instead of {n,}
    found = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS rank, '{r.kind}' AS kind, regexp_extract_all(t, p) AS m, regexp_split_to_array(t, p) AS g, "
        f"{r.group} AS grp, {r.least} AS least, p FROM (SELECT doc_id, coalesce(text, '') AS t, {_literal(plus.get(r.kind, r.pattern))} AS p FROM documents)"
        for i, r in enumerate(rules))
    group2 = _literal(secret_ledger.BASE_RULES[0].pattern)
    return f"""WITH f AS ({found}),
x AS (SELECT doc_id, rank, kind, grp, least, i, m[i] AS m, length(m[i]) + length(g[i]) AS step
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f WHERE len(m) > 0)),
y AS (SELECT *, sum(step) OVER (PARTITION BY doc_id, rank ORDER BY i) AS e FROM x),
z AS (SELECT doc_id, rank, kind, CAST(e - length(m) AS bigint) AS s, CAST(e AS bigint) AS e FROM y
      WHERE CASE WHEN grp = 2 THEN length(regexp_extract(m, {group2}, 2)) ELSE length(m) END >= least),
d AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
             count(*) FILTER (WHERE kind = 'hex') AS n_hex,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE rank < 3) AS base,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM z GROUP BY doc_id)
SELECT o.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents o LEFT JOIN d ON d.doc_id = o.doc_id"""


SQL_WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, CAST(n AS bigint) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first_id THEN first_id END AS refers_to FROM f"""


SQL_NEGATIVES = """WITH r AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label,
                          list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM r),
s AS MATERIALIZED (
  SELECT a.rid AS aid, a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
         CAST(coalesce(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS MATERIALIZED (SELECT aid, anchor_id, other AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY aid ORDER BY score DESC, other) AS nth
                   FROM s WHERE same)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, positive_id, positive_score, s.other AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.aid, nth ORDER BY s.score DESC, s.other) AS rank
  FROM p JOIN s ON s.aid = p.aid AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
  WHERE nth <= 5) WHERE rank <= 10"""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, table))


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@register("op10_bpe_codec")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_codec.encode_decode(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@register("op2_cover_pairs", SQL_COVER)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_pairs.near_duplicates(read(spark, sf_dir, "embeddings"))


@register("op5_secret_ledger", _secrets_sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths, _ = secret_ledger.scan(read(spark, sf_dir, "documents"))
    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return paths.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secret_ledger.joined("spans", base=True).cast("binary"), 256).alias("base_sha256"),
                        secret_ledger.joined("spans").alias("spans"))


@register("op6_kd_shards")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards.shards(read(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register("op7_signature_join", SQL_JACCARD)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_join.jaccard_groups(read(spark, sf_dir, "documents"), k=4, num=85, den=100)


@register("op8_warc_shards", SQL_WARC)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out_dir = scratch_path(spark, "llm-warc")
    warc_shards.write(read(spark, sf_dir, "pages"), out_dir)
    return warc_shards.read(spark, out_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op9_site_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps."""
    out = site_quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), carry=["doc_id"])
    return out.where("kept").select("doc_id", "p_good", "p_toxic", "rate_good", "rate_toxic", "kept")


@register("op1_html_tree")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.main_text(read(spark, sf_dir, "pages"))


@register("op3_template_leaks")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_leaks.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@register("op13_token_links")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_links.align(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return out.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))).drop("groups")


@register("op12_hard_negatives", SQL_NEGATIVES)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


@register("op11_language_id")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))
